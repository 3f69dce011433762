"""JSON functions. Documents are text; jsonb results are canonical: keys by length then bytes, one space after , and :."""

from __future__ import annotations

import decimal
import json
import re

from pyspark.sql import functions as F

from .base import col, cols, python
from .jsonpath import query as path_items


def parse(text):
    return json.loads(text, parse_float=decimal.Decimal)


def _scalar(x) -> str:
    if isinstance(x, decimal.Decimal):
        return format(x, "f")
    if isinstance(x, float):
        return repr(x)
    return json.dumps(x, ensure_ascii=False)


def dump(x, canonical: bool = True) -> str:
    if isinstance(x, dict):
        items = sorted(x.items(), key=lambda kv: (len(kv[0].encode()), kv[0].encode())) if canonical else x.items()
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {dump(v, canonical)}" for k, v in items) + "}"
    if isinstance(x, list):
        return "[" + ", ".join(dump(v, canonical) for v in x) + "]"
    return _scalar(x)


def doc(f):
    """A function of documents (the first argument) and values to a document, as one of Columns."""

    def value(text, *args):
        out = f(parse(text), *args)
        return None if out is MISSING else dump(out)

    value.__name__ = f.__name__
    return python("string")(value)


MISSING = object()


def as_text(x):
    return None if x is MISSING or x is None else x if isinstance(x, str) else dump(x)


def walk(x, path):
    for step in path:
        if isinstance(x, dict):
            x = x.get(step, MISSING)
        elif isinstance(x, list):
            try:
                x = x[int(step)]
            except (ValueError, IndexError):
                return MISSING
        else:
            return MISSING
        if x is MISSING:
            return MISSING
    return x


@python("string")
def get(text, key):
    """The -> operator: a member or element as a document."""
    out = walk(parse(text), [key])
    return None if out is MISSING else dump(out)


@python("string")
def get_text(text, key):
    return as_text(walk(parse(text), [key]))


@python("string")
def get_path(text, path):
    out = walk(parse(text), path)
    return None if out is MISSING else dump(out)


@python("string")
def get_path_text(text, path):
    return as_text(walk(parse(text), path))


def contains_value(a, b) -> bool:
    """a @> b: objects by members, arrays by elements in any order; an array contains a bare scalar."""
    if isinstance(a, dict):
        return isinstance(b, dict) and all(k in a and contains_value(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        if isinstance(b, list):
            return all(any(contains_value(x, y) if isinstance(y, (list, dict)) else _same(x, y) for x in a) for y in b)
        return not isinstance(b, dict) and any(_same(x, b) for x in a)
    return _same(a, b)


def _same(a, b) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool) and isinstance(a, (dict, list)) == isinstance(b, (dict, list))


contains = python("boolean")(lambda a, b: contains_value(parse(a), parse(b)))
contained = python("boolean")(lambda a, b: contains_value(parse(b), parse(a)))


def _exists(text, key):
    x = parse(text)
    return key in x if isinstance(x, dict) else any(v == key for v in x if isinstance(v, str)) if isinstance(x, list) else x == key


exists = python("boolean")(_exists)
exists_any = python("boolean")(lambda text, keys: any(_exists(text, k) for k in keys))
exists_all = python("boolean")(lambda text, keys: all(_exists(text, k) for k in keys))


@python("string")
def typeof(text):
    x = parse(text)
    return "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, decimal.Decimal)) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


@python("string")
def mysql_type(text):
    x = parse(text)
    return "NULL" if x is None else "BOOLEAN" if isinstance(x, bool) else "INTEGER" if isinstance(x, int) else "DOUBLE" if isinstance(x, decimal.Decimal) else "STRING" if isinstance(x, str) else "ARRAY" if isinstance(x, list) else "OBJECT"


@python("int")
def array_length(text):
    x = parse(text)
    if not isinstance(x, list):
        raise ValueError("cannot get array length of a non-array")
    return len(x)


@python("int")
def length(text):
    x = parse(text)
    return len(x) if isinstance(x, (list, dict)) else 1


def _depth(x) -> int:
    return 1 + max(map(_depth, x.values() if isinstance(x, dict) else x), default=0) if isinstance(x, (dict, list)) else 1


depth = python("int")(lambda text: _depth(parse(text)))


@python("array<string>")
def object_keys(text):
    return sorted(parse(text), key=lambda k: (len(k.encode()), k.encode()))


@python("array<struct<key:string,value:string>>")
def each(text):
    """Members as (key, document)."""
    return [{"key": k, "value": dump(v)} for k, v in parse(text).items()]


@python("array<struct<key:string,value:string>>")
def each_text(text):
    return [{"key": k, "value": as_text(v)} for k, v in parse(text).items()]


@python("array<string>")
def elements(text):
    return [dump(x) for x in parse(text)]


@python("array<string>")
def elements_text(text):
    return [as_text(x) for x in parse(text)]


def _pretty(x, depth=0):
    pad, end = "    " * (depth + 1), "    " * depth
    if isinstance(x, dict):
        if not x:
            return "{\n" + end + "}"
        items = sorted(x.items(), key=lambda kv: (len(kv[0].encode()), kv[0].encode()))
        return "{\n" + ",\n".join(f"{pad}{json.dumps(k, ensure_ascii=False)}: {_pretty(v, depth + 1)}" for k, v in items) + "\n" + end + "}"
    if isinstance(x, list):
        return "[\n" + ",\n".join(pad + _pretty(v, depth + 1) for v in x) + "\n" + end + "]" if x else "[\n" + end + "]"
    return _scalar(x)


pretty = python("string")(lambda text: _pretty(parse(text)))


def _index(items: list, step: str) -> int:
    i = int(step)
    return i + len(items) if i < 0 else i


def _set(x, path, new, create, insert=False, after=False):
    if not path:
        return new
    step, rest = path[0], path[1:]
    if isinstance(x, dict):
        if rest:
            return {**x, step: _set(x[step], rest, new, create, insert, after)} if step in x else x
        if insert and step in x:
            raise ValueError("cannot replace existing key")
        return {**x, step: new} if step in x or create else x
    if isinstance(x, list):
        i = _index(x, step)
        if rest:
            return [*x[:i], _set(x[i], rest, new, create, insert, after), *x[i + 1 :]] if 0 <= i < len(x) else x
        if insert:
            i = max(0, min(i + after, len(x)))
            return [*x[:i], new, *x[i:]]
        if 0 <= i < len(x):
            return [*x[:i], new, *x[i + 1 :]]
        return (x + [new] if i >= len(x) else [new, *x]) if create else x
    return x


@doc
def set_(x, path, new, create=True):
    return _set(x, path, parse(new), create)


@python("string", strict=False)
def set_lax(text, path, new, create=True, null_treatment="use_json_null"):
    if text is None or path is None:
        return None
    if new is None:
        if null_treatment == "raise_exception":
            raise ValueError("JSON value must not be null")
        if null_treatment == "return_target":
            return text
        if null_treatment == "delete_key":
            return dump(_delete_path(parse(text), path))
        new = "null"
    return dump(_set(parse(text), path, parse(new), create))


@doc
def insert(x, path, new, after=False):
    return _set(x, path, parse(new), True, insert=True, after=bool(after))


def _delete_path(x, path):
    if not path:
        return x
    step, rest = path[0], path[1:]
    if isinstance(x, dict) and step in x:
        return {k: (_delete_path(v, rest) if k == step else v) for k, v in x.items() if rest or k != step}
    if isinstance(x, list):
        i = _index(x, step)
        return [(_delete_path(v, rest) if j == i else v) for j, v in enumerate(x) if rest or j != i]
    return x


@doc
def delete(x, key):
    """Without a key, an element (by whole number) or a list of keys."""
    keys = key if isinstance(key, list) else [key]
    for k in keys:
        if isinstance(k, int):
            i = k + len(x) if k < 0 else k
            x = [v for j, v in enumerate(x) if j != i]
        elif isinstance(x, dict):
            x = {a: b for a, b in x.items() if a != k}
        else:
            x = [v for v in x if v != k]
    return x


delete_path = doc(lambda x, path: _delete_path(x, path))


@doc
def concat(a, b):
    b = parse(b)
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **b}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def _patch(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patch(out.get(k), v)
    return out


def _preserve(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: _preserve(a[k], v) if k in a else v for k, v in b.items()}}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


merge_patch = doc(lambda a, *more: _fold(_patch, a, more))
merge_preserve = doc(lambda a, *more: _fold(_preserve, a, more))


def _fold(f, a, more):
    for b in more:
        a = f(a, parse(b))
    return a


def _strip(x):
    if isinstance(x, dict):
        return {k: _strip(v) for k, v in x.items() if v is not None}
    return [_strip(v) for v in x] if isinstance(x, list) else x


strip_nulls = doc(_strip)


def _mysql_path(path: str) -> list[str]:
    steps = re.findall(r'\.(?:"((?:[^"\\]|\\.)*)"|(\w+))|\[(\d+)\]', path)
    return [a or b or c for a, b, c in steps]


def mysql_edit(create: bool, replace: bool):
    """JSON_SET, JSON_INSERT, JSON_REPLACE over path, value pairs; values are given as documents."""

    def edit(x, *pairs):
        for path, new in zip(pairs[::2], pairs[1::2], strict=True):
            steps = _mysql_path(path)
            there = walk(x, steps) is not MISSING
            if (there and replace) or (not there and create):
                parent = walk(x, steps[:-1])
                if not there and isinstance(parent, list):
                    steps = [*steps[:-1], str(len(parent))]
                x = _set(x, steps, parse(new), create)
        return x

    return doc(edit)


@doc
def mysql_remove(x, *paths):
    for p in paths:
        x = _delete_path(x, _mysql_path(p))
    return x


@doc
def array_append(x, path, new):
    steps = _mysql_path(path)
    old = walk(x, steps)
    if old is MISSING:
        return x
    return _set(x, steps, (old if isinstance(old, list) else [old]) + [parse(new)], False)


@doc
def array_insert(x, path, new):
    return _set(x, _mysql_path(path), parse(new), True, insert=True)


@python("string")
def mysql_extract(text, *paths):
    found = [walk(parse(text), _mysql_path(p)) for p in paths]
    found = [x for x in found if x is not MISSING]
    return None if not found else dump(found[0] if len(paths) == 1 else found)


@python("string")
def mysql_value(text, path):
    return as_text(walk(parse(text), _mysql_path(path)))


@python("boolean")
def contains_path(text, how, *paths):
    found = [walk(parse(text), _mysql_path(p)) is not MISSING for p in paths]
    return any(found) if how == "one" else all(found)


@python("boolean")
def overlaps(a, b):
    a, b = parse(a), parse(b)
    if isinstance(a, dict) and isinstance(b, dict):
        return any(k in a and _same(a[k], v) for k, v in b.items())
    a, b = (x if isinstance(x, list) else [x] for x in (a, b))
    return any(_same(x, y) for x in a for y in b)


def _strings(x, at="$"):
    if isinstance(x, str):
        yield at, x
    elif isinstance(x, dict):
        for k, v in x.items():
            yield from _strings(v, f"{at}.{k}" if re.fullmatch(r"\w+", k) else f'{at}."{k}"')
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from _strings(v, f"{at}[{i}]")


@python("string")
def search(text, how, pattern):
    """Paths of strings LIKE the pattern: the first as a document, or all."""
    rx = re.compile("".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in pattern), re.S)
    found = [at for at, s in _strings(parse(text)) if rx.fullmatch(s)]
    if not found:
        return None
    return dump(found[0] if how == "one" or len(found) == 1 else found)


def _unquote(text):
    return parse(text) if text[:1] == '"' else text


def build_object(*pairs):
    """Alternating names and values, as text."""
    members = [F.concat(element(col(n).cast("string")), F.lit(": "), element(v)) for n, v in zip(pairs[::2], pairs[1::2], strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def element(v):
    """A value as a document; null is null."""
    text = F.to_json(F.array(col(v)), {"ignoreNullFields": "false"})
    return F.when(col(v).isNull(), F.lit("null")).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def build_array(*values):
    return F.concat(F.lit("["), F.concat_ws(", ", *map(element, values)), F.lit("]"))


def to_json(x):
    return element(x)


def object_(keys, values=None):
    """From arrays of keys and values, or one array that alternates them."""
    if values is None:
        a = col(keys)
        places = F.sequence(F.lit(0), F.size(a) - 1, F.lit(2))
        keys, values = F.transform(places, lambda i: F.get(a, i)), F.transform(places, lambda i: F.get(a, i + 1))
    return F.to_json(F.map_from_arrays(col(keys), col(values)), {"ignoreNullFields": "false"})


canonical = python("string")(lambda text: dump(parse(text)))
valid = cols(lambda x: F.try_parse_json(x).isNotNull())
path_exists = python("boolean")(lambda text, path: bool(path_items(parse(text), path)))
path_match = python("boolean")(lambda text, path: (lambda found: found[0] if found and isinstance(found[0], bool) else None)(path_items(parse(text), path)))
path_query = python("array<string>")(lambda text, path: [dump(x) for x in path_items(parse(text), path)])
path_query_array = python("string")(lambda text, path: dump(path_items(parse(text), path)))
path_query_first = python("string")(lambda text, path: (lambda found: dump(found[0]) if found else None)(path_items(parse(text), path)))


def to_record(text, schema: str):
    return F.from_json(col(text), schema)


def to_recordset(text, schema: str):
    """Rows of an array of objects: inline() of the result."""
    return F.from_json(col(text), f"array<struct<{schema}>>")


_BOTH = {
    "build_object": build_object,
    "build_array": build_array,
    "object": object_,
    "typeof": typeof,
    "array_length": array_length,
    "object_keys": object_keys,
    "array_elements": elements,
    "array_elements_text": elements_text,
    "array_element": lambda j, i: get(j, col(i).cast("string")),
    "array_element_text": lambda j, i: get_text(j, col(i).cast("string")),
    "object_field": get,
    "object_field_text": get_text,
    "extract_path": lambda j, *p: get_path(j, F.array(*map(col, p))),
    "extract_path_text": lambda j, *p: get_path_text(j, F.array(*map(col, p))),
    "pretty": pretty,
    "delete": delete,
    "delete_path": delete_path,
    "concat": concat,
    "contains": contains,
    "strip_nulls": strip_nulls,
    "path_exists": path_exists,
    "path_match": path_match,
    "path_query": path_query,
    "path_query_array": path_query_array,
    "path_query_first": path_query_first,
    "each": each,
    "each_text": each_text,
}

FUNCTIONS = {
    **{f"{p}_{name}": f for name, f in _BOTH.items() for p in ("json", "jsonb")},
    "to_json": to_json,
    "to_jsonb": lambda x: canonical(element(x)),
    "row_to_json": lambda x: F.to_json(col(x), {"ignoreNullFields": "false"}),
    "row_to_jsonb": lambda x: canonical(F.to_json(col(x), {"ignoreNullFields": "false"})),
    "array_to_json": cols(lambda a: F.to_json(a, {"ignoreNullFields": "false"})),
    "json": cols(lambda x: x.cast("string")),
    "jsonb": canonical,
    "json_array": build_array,
    "json_scalar": element,
    "json_serialize": cols(lambda x: x.cast("string")),
    "json_valid": valid,
    "json_type": mysql_type,
    "json_length": length,
    "json_depth": depth,
    "json_keys": lambda j: F.to_json(object_keys(j)),
    "json_extract": mysql_extract,
    "json_value": mysql_value,
    "json_quote": element,
    "json_unquote": python("string")(_unquote),
    "json_set": mysql_edit(True, True),
    "json_insert": mysql_edit(True, False),
    "json_replace": mysql_edit(False, True),
    "json_remove": mysql_remove,
    "jsonb_set": set_,
    "jsonb_set_lax": set_lax,
    "jsonb_insert": insert,
    "json_merge": merge_preserve,
    "json_merge_patch": merge_patch,
    "json_merge_preserve": merge_preserve,
    "json_array_append": array_append,
    "json_array_insert": array_insert,
    "jsonb_contained": contained,
    "json_contains_path": contains_path,
    "json_overlaps": overlaps,
    "json_search": search,
    "jsonb_exists": exists,
    "jsonb_exists_any": exists_any,
    "jsonb_exists_all": exists_all,
    "json_storage_size": cols(F.octet_length),
    "json_to_record": to_record,
    "jsonb_to_record": to_record,
    "json_to_recordset": to_recordset,
    "jsonb_to_recordset": to_recordset,
    "json_populate_record": lambda base, text, schema: F.from_json(col(text), schema),
    "jsonb_populate_record": lambda base, text, schema: F.from_json(col(text), schema),
}
