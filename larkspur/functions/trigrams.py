"""Trigram similarity. Words are runs of letters and digits, in lower case, with two spaces before and one after."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .base import cols, python

THRESHOLD, WORD_THRESHOLD, STRICT_THRESHOLD = 0.3, 0.6, 0.5
_limit = {"similarity": THRESHOLD}


@cols
def show_trgm(s):
    """Sorted distinct trigrams."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))))
    return F.array_sort(F.array_distinct(grams))


def similarity(a, b):
    """Shared trigrams over all of both."""
    x, y = show_trgm(a), show_trgm(b)
    common = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - common
    return F.when(either > 0, common / either).when(either == 0, F.lit(0.0)).cast("float")


def _words(s: str) -> list[list[str]]:
    return [[f"  {w} "[i : i + 3] for i in range(len(w) + 1)] for w in re.findall(r"[^\W_]+", s.lower())]


def _extent(a: str, b: str, whole_words: bool) -> float:
    """The largest share of a's trigrams with those of a run of b's, in order: any run, or one of whole words."""
    own = {g for w in _words(a) for g in w}
    words = _words(b)
    grams = [g for w in words for g in w]
    ends = [0]
    for w in words:
        ends.append(ends[-1] + len(w))
    cuts = ends if whole_words else range(len(grams) + 1)
    best = 0.0
    for i in cuts:
        seen: set[str] = set()
        at = i
        for j in cuts:
            if j <= i:
                continue
            seen.update(grams[at:j])
            at = j
            common = len(seen & own)
            either = len(own) + len(seen) - common
            if either:
                best = max(best, common / either)
    return best


word_similarity = python("float")(lambda a, b: _extent(a, b, False))
strict_word_similarity = python("float")(lambda a, b: _extent(a, b, True))


def set_limit(value: float):
    """The threshold that similarity_op tests against from now on, in this session of Python."""
    _limit["similarity"] = float(value)
    return F.lit(float(value)).cast("float")


def swapped(f):
    return lambda a, b: f(b, a)


def distance(f):
    return lambda a, b: (F.lit(1.0).cast("float") - f(a, b)).cast("float")


def above(f, least):
    return lambda a, b: f(a, b) >= F.lit(least).cast("float")


FUNCTIONS = {
    "show_trgm": show_trgm,
    "similarity": similarity,
    "similarity_dist": distance(similarity),
    "similarity_op": lambda a, b: similarity(a, b) >= F.lit(_limit["similarity"]).cast("float"),
    "word_similarity": word_similarity,
    "strict_word_similarity": strict_word_similarity,
    "word_similarity_op": above(word_similarity, WORD_THRESHOLD),
    "strict_word_similarity_op": above(strict_word_similarity, STRICT_THRESHOLD),
    "word_similarity_commutator_op": above(swapped(word_similarity), WORD_THRESHOLD),
    "strict_word_similarity_commutator_op": above(swapped(strict_word_similarity), STRICT_THRESHOLD),
    "word_similarity_dist_op": distance(word_similarity),
    "strict_word_similarity_dist_op": distance(strict_word_similarity),
    "word_similarity_dist_commutator_op": distance(swapped(word_similarity)),
    "strict_word_similarity_dist_commutator_op": distance(swapped(strict_word_similarity)),
    "set_limit": set_limit,
    "show_limit": lambda: F.lit(_limit["similarity"]).cast("float"),
}
