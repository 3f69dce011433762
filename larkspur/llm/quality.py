"""Quality rules as a short-circuit cascade.

Every rule looks at some facts of a text and may reject it.  On a bounded
sample the operator measures what each rule costs and how many texts it
rejects, then orders the rules by rejections per second.  A text meets the
rules in that order until one rejects it; facts are worked out only when a
rule asks for them.  The verdict does not depend on the order.

Defined results: a null text has no words and fails the base rule; empty
tables give no rows; repeated rows are judged alike; other columns, null or
not, are untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import Hashes, covered, hash_words, lean, ship, split, windows

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: About so many documents, chosen by a hash of id and text, are used to measure the rules.
SAMPLE_ROWS = 2_000


class Facts:
    """Facts of one text, each computed when first asked for."""

    def __init__(self, text: str | None, known: Hashes):
        self.text, self._known = text or "", known

    @cached_property
    def words(self) -> list[bytes]:
        return split(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_exclamations(self) -> int:
        return self.text.count("!")

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        grams = windows(hash_words(self.words, self._known), 5)
        if len(grams) < 2:
            return 0
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        return int(covered(np.flatnonzero(twice), 5, self.n_words).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


def base_failed(f: Facts) -> bool:
    return f.n_words < 10 or 100 * f.n_repeat_words > 20 * f.n_words


#: Thresholds are integers, so that SQL can repeat them exactly.
RULES = (
    Rule("too_short", lambda f: f.n_words < 10),
    Rule("repeated_passages", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("exclamations", lambda f: 2 * f.n_exclamations > f.n_words),
    Rule("word_length", lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 15 * f.n_words),
    Rule("repeated_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
)


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: int
    seen: int

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def measure(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """What each rule costs and rejects on the sample: one row for each rule and task, summed by Spark."""
    ship(docs.sparkSession)
    n = docs.count()
    one_in = max(1, n // sample_rows)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0).select("text")

    def run(batches):
        known, spent, hit, seen = Hashes(), [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += 1
                for i, rule in enumerate(rules):
                    facts, began = Facts(text, known), time.perf_counter()
                    hit[i] += rule.rejects(facts)
                    spent[i] += time.perf_counter() - began
        if seen:
            yield pa.RecordBatch.from_pydict({"i": list(range(len(rules))), "seconds": spent, "rejected": hit, "seen": [seen] * len(rules)})

    sums = sample.mapInArrow(lean(run), "i long, seconds double, rejected long, seen long").groupBy("i").sum("seconds", "rejected", "seen").collect()
    by = {r["i"]: r for r in sums}
    return [Measured(x.name, *(by[i][1:] if i in by else (0.0, 0, 0))) for i, x in enumerate(rules)]


def plan(measured: list[Measured], rules=RULES) -> list[Rule]:
    """The rules by rejections per second, most first; ties by name."""
    gain = {m.name: m.gain for m in measured}
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def first_rejection(facts: Facts, ordered: list[Rule]) -> str | None:
    return next((r.name for r in ordered if r.rejects(facts)), None)


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """The base facts of each document, base_failed, kept, and the rule that rejected it."""
    ordered = plan(measure(docs, rules), rules)

    def run(batches):
        known = Hashes()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                f = Facts(text, known)
                why = first_rejection(f, ordered)
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, base_failed(f), why is None, why))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, _TYPES, strict=True))],
                names=["doc_id", *_NAMES],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]


def filter_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    ordered = plan(measure(docs, rules), rules)
    at = docs.columns.index("text")

    def run(batches):
        known = Hashes()
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(Facts(x, known), ordered) is None for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op7_quality_cascade(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
c AS (
  SELECT r, count(DISTINCT i + o) AS n_repeat_words
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g), (SELECT unnest(range(0, 5)) AS o)
  WHERE n >= 2 GROUP BY r),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(body, '[^!]', '', 'g'))::BIGINT AS n_exclamations,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (r)),
b AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_exclamations > n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > len(lines)) AS kept
FROM b
"""
