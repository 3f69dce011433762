"""Full-text search: vectors, queries, ranking and headlines, for the configurations `simple` and `english`.

A vector is array<struct<lexeme, positions, weights>>, sorted by lexeme; a
query is text in the syntax of to_tsquery.  English drops stop words, whose
positions still count, and stems by Porter's algorithm of 1980.
"""

from __future__ import annotations

import json
import math
import re
from collections import OrderedDict, defaultdict
from functools import lru_cache

from pyspark.sql import functions as F

from .base import col, python

VECTOR = "array<struct<lexeme:string,positions:array<int>,weights:array<string>>>"
LAST_POSITION = 16_383
RANKS = {"D": 0.1, "C": 0.2, "B": 0.4, "A": 1.0}

#: English stop words (fixed values).
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)

_TOKEN = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|https?://\S+|<[^<>]*>|&\w+;|\d+(?:\.\d+)+|[^\W_]+(?:-[^\W_]+)+|[^\W_]+")


def _measure(stem: str) -> int:
    """The number of vowel runs that a consonant follows."""
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", _shape(stem))))


def _shape(word: str) -> str:
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _cvc(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _shape(word)[-1] == "c"


#: Suffixes of Porter's steps 2 to 4 and what becomes of them (fixed values).
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


_stems: dict[str, str] = {}


def stem(word: str) -> str:
    if word not in _stems:
        if len(_stems) >= 100_000:
            _stems.clear()
        _stems[word] = _stem(word)
    return _stems[word]


def _stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or (w.endswith("ies") and len(w) > 4):
        w = w[:-2]
    elif w.endswith("ies"):  # ties, dies
        w = w[:-1]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            base = w[: -len(suffix)]
            if w.endswith(suffix) and "v" in _shape(base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        hit = max((p for p in table if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    hit = max((s for s in STEP4 if w.endswith(s)), key=len, default=None)
    if hit and _measure(w[: -len(hit)]) > 1 and (hit != "ion" or w[-4] in "st"):
        w = w[: -len(hit)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if _double(w) and w[-1] == "l" and _measure(w) > 1 else w


def token_kind(token: str) -> str:
    if "@" in token:
        return "email"
    if token.startswith(("http://", "https://")):
        return "url"
    if token[0] == "<":
        return "tag"
    if token[0] == "&":
        return "entity"
    if re.fullmatch(r"\d+", token):
        return "uint"
    if re.fullmatch(r"\d+\.\d+", token):
        return "float"
    if re.fullmatch(r"\d+(?:\.\d+)+", token):
        return "version"
    if "-" in token:
        return "asciihword" if token.isascii() and not re.search(r"\d", token) else "numhword" if re.search(r"\d", token) else "hword"
    return "asciiword" if token.isascii() and token.isalpha() else "numword" if re.search(r"\d", token) else "word"


def lexeme(token: str, config: str) -> str | None:
    """The lexeme of a token; None for a stop word."""
    word = token.lower()
    if config == "simple" or token_kind(token) not in ("asciiword", "word", "asciihword", "hword"):
        return word
    return None if word in STOP else stem(word)


def _known_config(config: str) -> str:
    config = config.removeprefix("pg_catalog.").lower()
    if config not in ("simple", "english"):
        raise ValueError(f'text search configuration "{config}" does not exist here')
    return config


def tokens(text: str, config: str) -> list[tuple[int, str | None]]:
    """(position, lexeme or None) in order; a compound stands before its parts."""
    config = _known_config(config)
    return [(min(i, LAST_POSITION), lex) for i, lex in enumerate(_lexemes_of(text, config), 1)]


def _lexemes_of(text: str, config: str) -> list[str | None]:
    """Lexemes in order, None for stop words.

    No token but a tag holds white space, so a text without tags is read by runs of other characters, most of which are known.
    """
    if (config, text) in _recent:
        return _recent[config, text]
    known = _lexemes[config]
    tagged = "<" in text and ">" in text
    out: list = []
    for t in _TOKEN.findall(text) if tagged else text.split():
        found = known.get(t)
        if found is None:
            found = tuple(x for m in _TOKEN.findall(t) for x in _token_lexemes(m, config))
            if len(t) <= 40:
                if len(known) >= 100_000:
                    known.clear()
                known[t] = found
        out += found
    if len(text) <= RECENT_CHARS:
        _recent[config, text] = out
        _recent_chars[0] += len(text)
        while _recent_chars[0] > RECENT_CHARS:
            (_, oldest), _ = _recent.popitem(last=False)
            _recent_chars[0] -= len(oldest)
    return out


#: The lexemes of the last texts, an Arrow batch or so (see session.small_batches): several functions of a query read the same.
RECENT_CHARS = 4 << 20
_recent: OrderedDict[tuple[str, str], list] = OrderedDict()
_recent_chars = [0]

#: By configuration: the lexemes of runs of characters, or of tokens, seen.
_lexemes: dict[str, dict[str, tuple]] = {"simple": {}, "english": {}}


def _token_lexemes(t: str, config: str) -> tuple:
    """The lexemes, None for stop words, that a token stands for: a compound's and its parts', none of a tag or entity."""
    kind = token_kind(t)
    if kind in ("tag", "entity"):
        return ()
    parts = [t, *t.split("-")] if kind in ("asciihword", "hword", "numhword") else [t.removeprefix("https://").removeprefix("http://")] if kind == "url" else [t]
    return tuple(lexeme(p, config) for p in parts)


def vector(text: str, config: str = "english") -> list[dict]:
    config = _known_config(config)
    places: dict[str, list[int]] = defaultdict(list)
    found = _lexemes_of(text, config)
    for at, lex in enumerate(found, 1):
        if lex:
            places[lex].append(at)
    if len(found) > LAST_POSITION:  # what stands beyond is at the last position, once
        for lex, own in places.items():
            if own[-1] > LAST_POSITION:
                places[lex] = [p for p in own if p < LAST_POSITION] + [LAST_POSITION]
    return [{"lexeme": k, "positions": places[k], "weights": ["D"] * len(places[k])} for k in sorted(places)]


# Queries: ("lex", word, prefix, weights) | ("not", q) | ("and" | "or", a, b) | ("phrase", distance, a, b) | None for nothing.

_QUERY = re.compile(r"\s*(?:(<->|<\d+>)|([&|!()])|'((?:[^']|'')*)'((?::[*ABCDabcd]+)?)|([^\s&|!():<']+)((?::[*ABCDabcd]+)?))")


def parse_query(text: str, config: str | None = None):
    """A tree from the syntax of to_tsquery; with a configuration, words become lexemes and stop words vanish."""
    items, at = [], 0
    while at < len(text.rstrip()):
        m = _QUERY.match(text, at)
        if not m:
            raise ValueError(f"syntax error in tsquery: {text!r}")
        items.append(m)
        at = m.end()
    pos = 0

    def peek():
        return items[pos] if pos < len(items) else None

    def operand():
        nonlocal pos
        m = peek()
        if m is None:
            raise ValueError(f"no operand in tsquery: {text!r}")
        pos += 1
        if m[2] == "!":
            q = operand()
            return q and ("not", q)
        if m[2] == "(":
            q = either()
            if not peek() or peek()[2] != ")":
                raise ValueError("unbalanced brackets")
            pos += 1
            return q
        word = (m[3].replace("''", "'") if m[3] is not None else m[5]) or ""
        marks = (m[4] if m[3] is not None else m[6]) or ""
        prefix, weights = "*" in marks, "".join(sorted(set(marks.upper()) & set("ABCD")))
        if config is None:
            return ("lex", word, prefix, weights)
        found = [x for _, x in tokens(word, config) if x]
        q = None
        for lex in found:
            q = ("lex", lex, prefix, weights) if q is None else ("phrase", 1, q, ("lex", lex, prefix, weights))
        return q

    def phrase():
        nonlocal pos
        q = operand()
        while peek() and peek()[1]:
            d = 1 if peek()[1] == "<->" else int(peek()[1][1:-1])
            pos += 1
            r = operand()
            q = ("phrase", d, q, r) if q and r else q or r
        return q

    def both():
        nonlocal pos
        q = phrase()
        while peek() and peek()[2] == "&":
            pos += 1
            r = phrase()
            q = ("and", q, r) if q and r else q or r
        return q

    def either():
        nonlocal pos
        q = both()
        while peek() and peek()[2] == "|":
            pos += 1
            r = both()
            q = ("or", q, r) if q and r else q or r
        return q

    q = either() if items else None
    if pos != len(items):
        raise ValueError(f"syntax error in tsquery: {text!r}")
    return q


_LEVEL = {"or": 0, "and": 1, "phrase": 2, "not": 3, "lex": 4}


def show_query(q, level: int = 0) -> str:
    if q is None:
        return ""
    kind = q[0]
    if kind == "lex":
        marks = ("*" if q[2] else "") + q[3]
        return "'" + q[1].replace("'", "''") + "'" + (":" + marks if marks else "")
    if kind == "not":
        out = "!" + show_query(q[1], 4 if q[1][0] != "lex" else 0)
    elif kind == "phrase":
        out = f"{show_query(q[2], 2)} <{'-' if q[1] == 1 else q[1]}> {show_query(q[3], 3)}"
    else:
        out = f"{show_query(q[1], _LEVEL[kind])} {'&' if kind == 'and' else '|'} {show_query(q[2], _LEVEL[kind])}"
    return f"( {out} )" if _LEVEL[kind] < level else out


def _fold(kind: str, lexemes: list):
    q = None
    for x in lexemes:
        term = ("lex", x, False, "")
        q = term if q is None else (kind, q, term)
    return q


def phrase_of(text: str, config: str):
    q, last = None, 0
    for at, lex in tokens(text, config):
        if lex:
            term = ("lex", lex, False, "")
            q = term if q is None else ("phrase", at - last, q, term)
            last = at
    return q


def websearch(text: str, config: str):
    """Words are wanted; or, -word and "phrases" as in web searches. Never an error."""
    alternatives, now = [], []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if not quoted and not minus and word.lower() == "or":
            if now:
                alternatives.append(now)
                now = []
            continue
        q = phrase_of(quoted, config) if quoted else phrase_of(re.sub(r"[^\w@.+-]", " ", word), config)
        if q:
            now.append(("not", q) if minus else q)
    if now:
        alternatives.append(now)
    out = None
    for group in alternatives:
        g = None
        for q in group:
            g = q if g is None else ("and", g, q)
        out = g if out is None else ("or", out, g)
    return out


def _entries(v: list, q) -> list[tuple[int, str]]:
    """(position, weight) of the lexemes of v that a term matches."""
    _, word, prefix, weights = q
    found = [e for e in v if (e["lexeme"].startswith(word) if prefix else e["lexeme"] == word)]
    return sorted((p, w) for e in found for p, w in zip(e["positions"] or [], e["weights"] or ["D"] * len(e["positions"] or []), strict=True) if not weights or w in weights)


def _has(v: list, q) -> bool:
    _, word, prefix, weights = q
    if weights:
        return bool(_entries(v, q))
    for e in v:
        if e["lexeme"] == word or prefix and e["lexeme"].startswith(word):
            return True
    return False


def _ends(v: list, q) -> set[int]:
    """Positions at which a match of q ends."""
    if q[0] == "lex":
        return {p for p, _ in _entries(v, q)}
    if q[0] == "phrase":
        left, right = _ends(v, q[2]), _ends(v, q[3])
        return {p + q[1] for p in left if p + q[1] in right}
    if q[0] == "or":
        return _ends(v, q[1]) | _ends(v, q[2])
    if q[0] == "and":
        return _ends(v, q[1]) & _ends(v, q[2])
    return set()


def matches(v: list, q) -> bool:
    if q is None:
        return False
    kind = q[0]
    if kind == "lex":
        return _has(v, q)
    if kind == "not":
        return not matches(v, q[1])
    if kind == "and":
        return matches(v, q[1]) and matches(v, q[2])
    if kind == "or":
        return matches(v, q[1]) or matches(v, q[2])
    return bool(_ends(v, q))


def _terms(q) -> list:
    if q is None:
        return []
    if q[0] == "lex":
        return [q]
    out: list = []
    for part in q[1:]:
        if isinstance(part, tuple):
            out += [t for t in _terms(part) if t not in out]
    return out


def rank(v: list, q) -> float:
    """Matched positions weigh by their place among a term's own, or, where all terms are wanted, by the distance of pairs."""
    terms = _terms(q)
    if not terms:
        return 0.0
    places = [[(p, RANKS[w]) for p, w in _entries(v, t)] for t in terms]
    if q[0] in ("and", "phrase") and len(terms) > 1:
        out = None
        for i, a in enumerate(places):
            for b in places[:i]:
                for p, wp in a:
                    for r, wr in b:
                        d = abs(p - r)
                        if d:
                            near = 1e-30 if d > 100 else 1.0 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))
                            out = 1.0 - (1.0 - (out or 0.0)) * (1.0 - math.sqrt(wp * wr * near))
        return out or 0.0
    total = 0.0
    for own in places:
        if own:
            sums = sum(w / (j + 1) ** 2 for j, (_, w) in enumerate(own))
            top = max(range(len(own)), key=lambda j: (own[j][1], -j))
            total += (own[top][1] + sums - own[top][1] / (top + 1) ** 2) / 1.64493406685
    return total / len(terms)


def rank_cover(v: list, q) -> float:
    """The sum over the shortest stretches that hold all terms: mean weight, over one more than the words between."""
    terms = _terms(q)
    places = sorted((p, i, RANKS[w]) for i, t in enumerate(terms) for p, w in _entries(v, t))
    out, begin = 0.0, 0
    while begin < len(places):
        seen, end = set(), begin
        while end < len(places) and len(seen | {places[end][1]}) < len(terms):
            seen.add(places[end][1])
            end += 1
        if end == len(places):
            break
        while any(places[j][1] == places[begin][1] for j in range(begin + 1, end + 1)):
            begin += 1
        inside = places[begin : end + 1]
        noise = (inside[-1][0] - inside[0][0]) - (len(inside) - 1)
        out += len(inside) / sum(1 / w for *_, w in inside) / (max(0, noise) + 1)
        begin += 1
    return out


def headline(text: str, q, config: str, start: str = "<b>", stop: str = "</b>", most: int = 35) -> str:
    """Words around the first matches, with matched words marked."""
    words = {t[1] for t in _terms(q) if not t[2]}
    prefixes = tuple(t[1] for t in _terms(q) if t[2])
    spans = [(m.start(), m.end(), lexeme(m[0], config)) for m in _TOKEN.finditer(text)]
    hit = [lex is not None and (lex in words or bool(prefixes) and lex.startswith(prefixes)) for *_, lex in spans]
    first = next((i for i, h in enumerate(hit) if h), 0)
    lo = 0 if len(spans) <= most else max(0, min(first, len(spans) - most))
    shown = range(lo, min(len(spans), lo + most))
    if not shown:
        return text
    out, at = "", 0 if lo == 0 else spans[lo][0]
    for i in shown:
        a, b, _ = spans[i]
        out += text[at:a] + (start + text[a:b] + stop if hit[i] else text[a:b])
        at = b
    return out + (text[at:] if shown.stop == len(spans) else "")


def _rewrite(q, target, new):
    if q == target:
        return new
    if q is None or q[0] == "lex":
        return q
    parts = [_rewrite(p, target, new) if isinstance(p, tuple) else p for p in q[1:]]
    if q[0] == "not":
        return ("not", parts[0]) if parts[0] else None
    if q[0] in ("and", "or"):
        a, b = parts
        return (q[0], a, b) if a and b else a or b
    return ("phrase", *parts)


def _strings(x):
    if isinstance(x, str):
        yield x
    elif isinstance(x, dict):
        for v in x.values():
            yield from _strings(v)
    elif isinstance(x, list):
        for v in x:
            yield from _strings(v)


def _two(f, returns):
    """f(config, text), or f(text) in English, as a function of Columns."""
    udf = python(returns, bind=True)(lambda config, text: f(text, config))
    return lambda *a: udf(*a) if len(a) == 2 else udf("english", *a)


@lru_cache(1_000)
def _query(text: str):
    return parse_query(text)


to_tsvector = _two(vector, VECTOR)
to_tsquery = _two(lambda t, c: show_query(parse_query(t, c)), "string")
plainto_tsquery = _two(lambda t, c: show_query(_fold("and", [x for _, x in tokens(t, c) if x])), "string")
phraseto_tsquery = _two(lambda t, c: show_query(phrase_of(t, c)), "string")
websearch_to_tsquery = _two(lambda t, c: show_query(websearch(t, c)), "string")
ts_match = python("boolean", bind=True)(lambda v, q: matches(v, _query(q)))
ts_rank = python("float", bind=True)(lambda v, q: rank(v, _query(q)))
ts_rank_cd = python("float", bind=True)(lambda v, q: rank_cover(v, _query(q)))
_headline = python("string")(lambda config, text, q: headline(text, parse_query(q), config))
ts_rewrite = python("string")(lambda q, target, new: show_query(_rewrite(parse_query(q), parse_query(target), parse_query(new))))
tsquery_and = python("string")(lambda a, b: show_query(_joined("and", a, b)))
tsquery_or = python("string")(lambda a, b: show_query(_joined("or", a, b)))
tsquery_not = python("string")(lambda a: show_query(("not", parse_query(a)) if a else None))
_phrase = python("string")(lambda a, b, d: show_query(("phrase", d, parse_query(a), parse_query(b)) if a and b else parse_query(a or b)))


def _joined(kind, a, b):
    x, y = parse_query(a), parse_query(b)
    return (kind, x, y) if x and y else x or y


def _nodes(q) -> int:
    return 0 if q is None else 1 + sum(_nodes(p) for p in q[1:] if isinstance(p, tuple))


def setweight(v, weight: str, lexemes=None):
    only = (lambda e: F.array_contains(col(lexemes), e["lexeme"])) if lexemes is not None else (lambda e: F.lit(True))
    return F.transform(col(v), lambda e: F.struct(e["lexeme"].alias("lexeme"), e["positions"].alias("positions"), F.when(only(e), F.transform(e["weights"], lambda w: F.lit(weight.upper()))).otherwise(e["weights"]).alias("weights")))


def strip(v):
    none = F.array().cast("array<int>")
    return F.transform(col(v), lambda e: F.struct(e["lexeme"].alias("lexeme"), none.alias("positions"), F.array().cast("array<string>").alias("weights")))


def ts_filter(v, weights: str):
    letters = F.array(*[F.lit(w.upper()) for w in weights])
    kept = F.transform(
        col(v),
        lambda e: F.struct(
            e["lexeme"].alias("lexeme"),
            F.filter(e["positions"], lambda p, i: F.array_contains(letters, F.get(e["weights"], i))).alias("positions"),
            F.filter(e["weights"], lambda w: F.array_contains(letters, w)).alias("weights"),
        ),
    )
    return F.filter(kept, lambda e: F.size(e["positions"]) > 0)


def ts_delete(v, lexemes):
    gone = col(lexemes) if not isinstance(lexemes, str) else F.array(F.lit(lexemes))
    return F.filter(col(v), lambda e: ~F.array_contains(gone, e["lexeme"]))


def array_to_tsvector(a):
    empty = F.array().cast("array<int>")
    return F.transform(F.array_sort(F.array_distinct(col(a))), lambda x: F.struct(x.alias("lexeme"), empty.alias("positions"), F.array().cast("array<string>").alias("weights")))


@python(VECTOR)
def read_vector(text):
    """A vector from its text form: 'lexeme':1A,2."""
    out: dict[str, list] = {}
    for quoted, bare, places in re.findall(r"(?:'((?:[^']|'')*)'|([^\s':]+))(?::([\dA-D,]+))?", text):
        entry = out.setdefault(quoted.replace("''", "'") or bare, [])
        entry += [(int(re.sub(r"\D", "", p)), re.sub(r"\d", "", p) or "D") for p in places.split(",") if p]
    return [{"lexeme": k, "positions": [p for p, _ in v], "weights": [w for _, w in v]} for k, v in sorted(out.items(), key=lambda kv: kv[0].encode())]


ts_debug = python("array<struct<alias:string,token:string,lexemes:array<string>>>")(
    lambda config, text: [{"alias": token_kind(m[0]), "token": m[0], "lexemes": [x for x in [lexeme(m[0], config)] if x]} for m in _TOKEN.finditer(text)]
)
json_to_tsvector = python(VECTOR)(lambda config, text: vector(" . ".join(_strings(json.loads(text))), config))

FUNCTIONS = {
    "to_tsvector": to_tsvector,
    "to_tsquery": to_tsquery,
    "plainto_tsquery": plainto_tsquery,
    "phraseto_tsquery": phraseto_tsquery,
    "websearch_to_tsquery": websearch_to_tsquery,
    "ts_match": ts_match,
    "ts_rank": ts_rank,
    "ts_rank_cd": ts_rank_cd,
    "ts_headline": lambda *a: _headline(*a) if len(a) == 3 else _headline("english", *a),
    "ts_lexize": python("array<string>")(lambda d, w: [w.lower()] if d == "simple" else [x for x in [lexeme(w, "english")] if x]),
    "ts_rewrite": ts_rewrite,
    "ts_delete": ts_delete,
    "ts_filter": ts_filter,
    "setweight": setweight,
    "strip": strip,
    "numnode": python("int")(lambda q: _nodes(parse_query(q))),
    "querytree": python("string")(lambda q: show_query(parse_query(q)) or "T"),
    "tsquery_and": tsquery_and,
    "tsquery_or": tsquery_or,
    "tsquery_not": tsquery_not,
    "tsquery_phrase": lambda a, b, d=1: _phrase(a, b, d),
    "tsvector_length": lambda v: F.size(col(v)),
    "tsvector_to_array": lambda v: F.transform(col(v), lambda e: e["lexeme"]),
    "array_to_tsvector": array_to_tsvector,
    "get_current_ts_config": lambda: F.lit("english"),
    "ts_debug": ts_debug,
    "json_to_tsvector": json_to_tsvector,
    "jsonb_to_tsvector": json_to_tsvector,
    "tsvector": read_vector,
    "tsquery": python("string")(lambda q: show_query(parse_query(q))),
}
