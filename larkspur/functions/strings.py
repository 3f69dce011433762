"""String and regular-expression functions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from .base import col, cols, null_if_any, python




@cols
def initcap(s):
    """The first letter of each run of letters and digits in upper case, the rest in lower."""
    chars = F.split(F.lower(s), "")
    big = F.transform(chars, lambda c, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"^[\p{L}\p{N}]$"), F.upper(c)).otherwise(c))
    return F.when(s == "", s).otherwise(F.array_join(big, ""))


def concat(*args):
    """Arguments as text, nulls skipped."""
    return F.concat_ws("", *[col(a).cast("string") for a in args])


def substr(s, start, length=None):
    """Positions from 1; a length counts from the given start even where that lies before the text."""
    s, start = col(s), col(start).cast("int")
    if length is None:
        return F.substring(s, F.greatest(start, F.lit(1)), F.length(s) + 1)
    end = start + col(length).cast("int")
    begin = F.greatest(start, F.lit(1))
    return null_if_any(F.substring(s, begin, F.greatest(end - begin, F.lit(0))), s, start, end)


def substring(s, start, length=None):
    """substr, or with a text as second argument the match (or its first group) of a pattern."""
    return regexp_first(s, start) if isinstance(start, str) else substr(s, start, length)


@cols
def left(s, n):
    n = n.cast("int")
    return null_if_any(F.substring(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, F.lit(0)))), s, n)


@cols
def right(s, n):
    n = n.cast("int")
    size = F.when(n >= 0, F.least(n, F.length(s))).otherwise(F.greatest(F.length(s) + n, F.lit(0)))
    return null_if_any(F.substring(s, F.length(s) - size + 1, size), s, n)


def lpad(s, n, fill=" "):
    return F.lpad(col(s), col(n).cast("int"), col(fill))


def rpad(s, n, fill=" "):
    return F.rpad(col(s), col(n).cast("int"), col(fill))


def ltrim(s, chars=" "):
    return F.ltrim(col(s), col(chars))


def rtrim(s, chars=" "):
    return F.rtrim(col(s), col(chars))


def btrim(s, chars=" "):
    return F.btrim(col(s), col(chars))


def string_to_array(s, delimiter, null=None):
    """Parts between delimiters; null delimiter: characters; parts equal to `null` become null; the empty text has no parts."""
    s = col(s)
    if delimiter is None:
        parts = F.split(s, "")
    elif isinstance(delimiter, str) and delimiter == "":
        parts = F.array(s)
    else:
        parts = F.split(s, re.escape(delimiter), -1) if isinstance(delimiter, str) else F.split(s, F.concat(F.lit("\\Q"), col(delimiter), F.lit("\\E")), -1)
    if null is not None:
        parts = F.transform(parts, lambda x: F.nullif(x, col(null)))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(parts)


def overlay(s, new, start, length=None):
    s, new, start = col(s), col(new), col(start).cast("int")
    return F.overlay(s, new, start, F.length(new) if length is None else col(length).cast("int"))


def insert(s, pos, length, new):
    """The text with `length` characters from `pos` on replaced; unchanged where pos lies outside."""
    s, pos, length, new = col(s), col(pos).cast("int"), col(length).cast("int"), col(new)
    size = F.when((length < 0) | (pos + length > F.length(s)), F.length(s) - pos + 1).otherwise(length)
    return F.when((pos < 1) | (pos > F.length(s)), s).otherwise(F.overlay(s, new, pos, size))


@python("bigint")
def ord_(s):
    """The bytes of the first character as a number."""
    return int.from_bytes(s[:1].encode(), "big") if s else 0


@python("string")
def chr_(n):
    if n <= 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
        raise ValueError("requested character is not valid")
    return chr(n)


def char(*codes):
    return F.concat_ws("", *[F.when(col(c).isNotNull(), F.chr(col(c))) for c in codes])


@python("string")
def unistr(s):
    one = re.compile(r"\\(?:(\\)|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|\+([0-9A-Fa-f]{6})|([0-9A-Fa-f]{4}))")
    return one.sub(lambda m: m[1] or chr(int(m[2] or m[3] or m[4] or m[5], 16)), s)


@python("string")
def to_ascii(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if ord(c) < 128)


def _quote_ident(s: str) -> str:
    return s if re.fullmatch(r"[a-z_][a-z0-9_$]*", s) else '"' + s.replace('"', '""') + '"'


def _quote_literal(s: str) -> str:
    return ("E" if "\\" in s else "") + "'" + s.replace("\\", "\\\\").replace("'", "''") + "'"


@python("string", strict=False)
def _format(template, *args):
    if template is None:
        return None
    nth = 0

    def one(m):
        nonlocal nth
        if m[0] == "%%":
            return "%"
        if m[1]:
            nth = int(m[1])
        else:
            nth += 1
        if nth > len(args):
            raise ValueError("too few arguments for format()")
        value = args[nth - 1]
        if m[4] == "I":
            if value is None:
                raise ValueError("null values cannot be formatted as an SQL identifier")
            text = _quote_ident(str(value))
        elif m[4] == "L":
            text = "NULL" if value is None else _quote_literal(str(value))
        else:
            text = "" if value is None else str(value)
        width = int(m[3] or 0)
        return text.ljust(width) if m[2] else text.rjust(width)

    return re.sub(r"%(?:%|(?:(\d+)\$)?(-)?(\d+)?([sIL]))", one, template)


def format_(template, *args):
    """%s, %I, %L with positions and widths."""
    return _format(template, *[col(a).cast("string") for a in args])


@cols
def quote(s):
    """A MySQL literal; the text NULL for null."""
    body = F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\0"), F.lit("\\0"))
    return F.when(s.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), body, F.lit("'")))


@cols
def quote_ident(s):
    return F.when(s.rlike(r"^[a-z_][a-z0-9_$]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


@cols
def quote_literal(s):
    s = s.cast("string")
    slashes = F.instr(s, "\\") > 0
    body = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.concat(F.when(slashes, F.lit("E")).otherwise(F.lit("")), F.lit("'"), body, F.lit("'"))


@cols
def quote_nullable(s):
    return F.coalesce(quote_literal(s), F.lit("NULL"))


@python("array<string>")
def parse_ident(s):
    out, at = [], 0
    one = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_\u0080-￿][\w$]*))\s*(\.|$)')
    while True:
        m = one.match(s, at)
        if not m:
            raise ValueError(f"string is not a valid identifier: {s}")
        out.append(m[1].replace('""', '"') if m[1] is not None else m[2].lower())
        at = m.end()
        if not m[3]:
            return out


@cols
def strcmp(a, b):
    return null_if_any(F.when(a < b, -1).when(a > b, 1).otherwise(0), a, b)


def field(x, *among):
    """Place of x among the others; 0 if absent or null."""
    return F.coalesce(F.array_position(F.array(*map(col, among)), col(x)), F.lit(0)).cast("int")


def elt(n, *texts):
    return F.get(F.array(*map(col, texts)), col(n).cast("int") - 1)


def make_set(bits, *texts):
    return F.when(col(bits).isNull(), F.lit(None)).otherwise(F.concat_ws(",", *[F.when(col(bits).bitwiseAND(F.lit(1 << i)) != 0, col(t)) for i, t in enumerate(texts)]))


def export_set(bits, on, off, separator=",", count=64):
    bits = col(bits).cast("long")
    return null_if_any(F.concat_ws(separator, *[F.when(F.shiftright(bits, i).bitwiseAND(F.lit(1)) != 0, col(on)).otherwise(col(off)) for i in range(min(count, 64))]), bits)


@cols
def difference(a, b):
    x, y = F.soundex(a), F.soundex(b)
    return sum((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5))


@cols
def levenshtein_less_equal(a, b, most):
    d = F.levenshtein(a, b)
    return F.when(d > most, most + 1).otherwise(d)


def like(s, pattern, escape="\\"):
    """LIKE: a pattern of % and _; an empty escape has none."""
    rx = _like_regex(pattern, escape)
    return col(s).rlike(rx)


def ilike(s, pattern, escape="\\"):
    return col(s).rlike("(?i)" + _like_regex(pattern, escape))


def _like_regex(pattern: str, escape: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def like_escape(pattern: str, escape: str) -> str:
    """The pattern with its escape character replaced by the backslash."""
    return re.sub(re.escape(escape) + "(.)", lambda m: "\\" + m[1], pattern.replace("\\", "\\\\"))


def similar_escape(pattern: str, escape: str = "\\") -> str:
    """A SIMILAR TO pattern as a regular expression of the whole text."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif in_class:
            in_class = c != "]"
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
        else:
            out.append({"%": ".*", "_": ".", ".": r"\.", "^": r"\^", "$": r"\$", "\\": r"\\"}.get(c, c))
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def similar_to(s, pattern: str, escape: str = "\\"):
    return col(s).rlike(similar_escape(pattern, escape))


def substring_similar(s, pattern: str, escape: str):
    """The middle of a pattern cut in three by escape-quote marks."""
    parts = pattern.split(escape + '"')
    a, b, c = (similar_escape(p, escape)[len("(?s)^(?:") : -2] for p in parts) if len(parts) == 3 else ("", similar_escape(pattern, escape)[8:-2], "")
    rx = f"(?s)^(?:{a})({b})(?:{c})$"
    return F.when(col(s).rlike(rx), F.regexp_extract(col(s), rx, 1))


@python("string")
def normalize(s, form="NFC"):
    return unicodedata.normalize(form.upper(), s)


@python("boolean")
def is_normalized(s, form="NFC"):
    return unicodedata.is_normalized(form.upper(), s)


@python("boolean")
def unicode_assigned(s):
    return all(unicodedata.category(c) != "Cn" for c in s)


#: Names of types by their number in PostgreSQL's catalogue (fixed values).
TYPE_NAMES = {16: "boolean", 17: "bytea", 18: '"char"', 19: "name", 20: "bigint", 21: "smallint", 23: "integer", 25: "text", 26: "oid", 114: "json", 700: "real", 701: "double precision", 1042: "character", 1043: "character varying", 1082: "date", 1083: "time without time zone", 1114: "timestamp without time zone", 1184: "timestamp with time zone", 1186: "interval", 1700: "numeric", 2950: "uuid", 3802: "jsonb"}


@python("string", strict=False)
def format_type(oid, modifier=None):
    if oid is None:
        return None
    name = TYPE_NAMES.get(oid, "???")
    if modifier is None or modifier < 0:
        return name
    if oid in (1042, 1043):
        return f"{name}({modifier - 4})"
    if oid == 1700:
        return f"{name}({(modifier - 4) >> 16},{(modifier - 4) & 0xFFFF})"
    return name


#: English number words (fixed values).
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()


def _under_thousand(n: int) -> str:
    if n >= 100:
        return f"{_SMALL[n // 100]} hundred" + (f" {_under_thousand(n % 100)}" if n % 100 else "")
    return _SMALL[n] if n < 20 else _TENS[n // 10] + (f" {_SMALL[n % 10]}" if n % 10 else "")


@python("string")
def cash_words(amount):
    cents = round(abs(float(amount)) * 100)
    whole, rest, words = cents // 100, cents % 100, []
    for scale, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand")):
        if whole >= scale:
            words.append(f"{_under_thousand(whole // scale)} {name}")
            whole %= scale
    if whole or not words:
        words.append(_under_thousand(whole))
    text = f"{'minus ' if amount < 0 else ''}{' '.join(words)} dollar{'' if cents // 100 == 1 else 's'} and {_under_thousand(rest)} cent{'' if rest == 1 else 's'}"
    return text[0].upper() + text[1:]


# Regular expressions. Patterns are Java's; \m \M \y and \A \Z of the advanced flavour are translated.


def java_regex(pattern: str, flags: str = "") -> str:
    for a, b in ((r"\m", r"\b(?=\w)"), (r"\M", r"\b(?<=\w)"), (r"\y", r"\b"), (r"\Y", r"\B")):
        pattern = re.sub(r"(?<!\\)((?:\\\\)*)" + re.escape(a), lambda m, b=b: m[1] + b, pattern)
    inline = "".join(sorted({"i": "i", "x": "x", "n": "m", "m": "m"}[f] for f in set(flags) if f in "ixnm"))
    return ("" if "n" in flags or "m" in flags else "(?s)") + (f"(?{inline})" if inline else "") + pattern


def regexp_replace(s, pattern: str, replacement: str, flags: str = ""):
    """The first match, or all with flag g, replaced; \\1..\\9 and \\& stand for groups."""
    rx = java_regex(pattern, flags)
    to = re.sub(r"\\([0-9&\\])|([$])", lambda m: r"\$" if m[2] else "$0" if m[1] == "&" else r"\\" if m[1] == "\\" else f"${m[1]}", replacement)
    if "g" in flags:
        return F.regexp_replace(col(s), rx, to)
    # only the first: what stands before it is kept as group 1, the match is group 2
    return F.regexp_replace(col(s), rf"\A((?s:.*?))({rx})", "$1" + re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 2}", to))


def _groups(pattern: str) -> int:
    return re.compile(re.sub(r"\\[mMyY]", "", re.sub(r"\(\?<[a-zA-Z]\w*>", "(", pattern))).groups


def regexp_first(s, pattern: str, flags: str = ""):
    rx = java_regex(pattern, flags)
    return F.when(col(s).rlike(rx), F.regexp_extract(col(s), rx, 1 if _groups(pattern) else 0))


def regexp_match(s, pattern: str, flags: str = ""):
    """The groups of the first match (or the match) as an array; null without a match."""
    rx, n = java_regex(pattern, flags), _groups(pattern)
    return F.when(col(s).rlike(rx), F.array(*[F.regexp_extract(col(s), rx, i) for i in (range(1, n + 1) if n else [0])]))


def regexp_matches(s, pattern: str, flags: str = ""):
    """All matches with flag g, else the first, as arrays of groups; explode for rows."""
    if "g" not in flags:
        one = regexp_match(s, pattern, flags)
        return F.when(one.isNull(), F.array().cast("array<array<string>>")).otherwise(F.array(one))
    rx, n = java_regex(pattern, flags), _groups(pattern)
    parts = [F.regexp_extract_all(col(s), F.lit(rx), F.lit(i)) for i in (range(1, n + 1) if n else [0])]
    return F.transform(parts[0], lambda x, i: F.array(*[F.get(p, i) for p in parts]))


def regexp_split_to_array(s, pattern: str, flags: str = ""):
    return F.split(col(s), java_regex(pattern, flags), -1)


def regexp_count(s, pattern: str, start: int = 1, flags: str = ""):
    return F.regexp_count(F.substring(col(s), F.lit(start), F.length(col(s)) + 1), F.lit(java_regex(pattern, flags)))


def regexp_like(s, pattern: str, flags: str = ""):
    return col(s).rlike(java_regex(pattern, flags))


def regexp_substr(s, pattern: str, start: int = 1, nth: int = 1, flags: str = "", group: int = 0):
    every = F.regexp_extract_all(F.substring(col(s), F.lit(start), F.length(col(s)) + 1), F.lit(java_regex(pattern, flags)), F.lit(group))
    return F.get(every, F.lit(nth - 1))


def regexp_instr(s, pattern: str, start: int = 1, nth: int = 1, end: int = 0, flags: str = ""):
    """Place of the nth match, or of what follows it; 0 without one."""
    rest = F.substring(col(s), F.lit(start), F.length(col(s)) + 1)
    rx = java_regex(pattern, flags)
    parts = F.split(rest, rx, nth + 1)
    matches = F.regexp_extract_all(rest, F.lit(rx), F.lit(0))
    before = F.length(F.concat_ws("", F.slice(parts, 1, nth), F.slice(matches, 1, nth - 1)))
    at = before + start + (F.length(F.get(matches, F.lit(nth - 1))) if end else 0)
    return F.when(col(s).isNull(), None).when(F.size(matches) >= nth, at).otherwise(0)


FUNCTIONS = {
    "upper": cols(F.upper),
    "ucase": cols(F.upper),
    "lower": cols(F.lower),
    "lcase": cols(F.lower),
    "casefold": python("string")(str.casefold),
    "initcap": initcap,
    "length": cols(F.length),
    "char_length": cols(F.char_length),
    "character_length": cols(F.character_length),
    "octet_length": cols(F.octet_length),
    "bit_length": cols(F.bit_length),
    "textlen": cols(F.length),
    "concat": concat,
    "concat_ws": lambda sep, *a: F.concat_ws(sep, *[col(x).cast("string") for x in a]),
    "textcat": cols(F.concat),
    "nameconcatoid": cols(lambda name, oid: F.concat(name, F.lit("_"), oid.cast("string"))),
    "substr": substr,
    "substring": substring,
    "mid": substr,
    "__substring_similar": substring_similar,
    "left": left,
    "right": right,
    "lpad": lpad,
    "rpad": rpad,
    "ltrim": ltrim,
    "rtrim": rtrim,
    "btrim": btrim,
    "trim": btrim,
    "replace": cols(F.replace),
    "translate": lambda s, a, b: F.translate(col(s), a, b),
    "reverse": cols(F.reverse),
    "repeat": cols(lambda s, n: F.repeat(s, F.greatest(n.cast("int"), F.lit(0)))),
    "space": cols(lambda n: F.repeat(F.lit(" "), F.greatest(n.cast("int"), F.lit(0)))),
    "strpos": cols(lambda s, x: F.position(x, s)),
    "instr": cols(lambda s, x: F.position(x, s)),
    "locate": lambda x, s, start=1: F.position(col(x), col(s), col(start)),
    "position": cols(lambda x, s: F.position(x, s)),
    "split_part": cols(F.split_part),
    "substring_index": lambda s, d, n: F.substring_index(col(s), d, n),
    "string_to_array": string_to_array,
    "starts_with": cols(F.startswith),
    "text_starts_with": cols(F.startswith),
    "ends_with": cols(F.endswith),
    "overlay": overlay,
    "insert": insert,
    "ascii": python("int")(lambda s: ord(s[0]) if s else 0),
    "ord": ord_,
    "chr": chr_,
    "char": char,
    "unistr": unistr,
    "to_ascii": to_ascii,
    "format": format_,
    "quote": quote,
    "quote_ident": quote_ident,
    "quote_literal": quote_literal,
    "quote_nullable": quote_nullable,
    "parse_ident": parse_ident,
    "strcmp": strcmp,
    "find_in_set": cols(F.find_in_set),
    "field": field,
    "elt": elt,
    "make_set": make_set,
    "export_set": export_set,
    "soundex": cols(F.soundex),
    "difference": difference,
    "levenshtein": cols(F.levenshtein),
    "levenshtein_less_equal": levenshtein_less_equal,
    "like_escape": like_escape,
    "__similar_to": similar_to,
    "similar_escape": similar_escape,
    "similar_to_escape": similar_escape,
    "normalize": lambda s, form="NFC": normalize(s, form),
    "is_normalized": lambda s, form="NFC": is_normalized(s, form),
    "unicode_assigned": unicode_assigned,
    "text_lt": cols(lambda a, b: a < b),
    "text_le": cols(lambda a, b: a <= b),
    "text_gt": cols(lambda a, b: a > b),
    "text_ge": cols(lambda a, b: a >= b),
    "texteq": cols(lambda a, b: a == b),
    "textne": cols(lambda a, b: a != b),
    "text_larger": cols(F.greatest),
    "text_smaller": cols(F.least),
    "bpchar_larger": cols(lambda a, b: F.greatest(F.rtrim(a), F.rtrim(b))),
    "bpchar_smaller": cols(lambda a, b: F.least(F.rtrim(a), F.rtrim(b))),
    "format_type": lambda oid, m=None: format_type(oid, F.lit(m).cast("int")),
    "cash_words": cash_words,
    "regexp_replace": regexp_replace,
    "regexp_match": regexp_match,
    "regexp_matches": regexp_matches,
    "regexp_split_to_array": regexp_split_to_array,
    "regexp_count": regexp_count,
    "regexp_instr": regexp_instr,
    "regexp_like": regexp_like,
    "regexp_substr": regexp_substr,
}
