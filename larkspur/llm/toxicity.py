"""Toxicity by a factorization machine over hashed terms.

Terms of a text: each distinct word in lower case without its punctuation, and
its first four and five letters.  Terms are hashed to 2**22 slots.  TERMS slots
that tell the labels apart best by themselves (chi-squared, counted over the
sample) and the COMMON slots of most documents, which may tell something only
beside another, get a weight and a vector of FACTORS numbers.  The machine adds
the weights of the terms present and the products of the vectors of every pair
of them, so a pair (an insult, and the group it is aimed at) can count for more
than its terms, or for the opposite.

Training: logistic loss, Adam, on at most TRAIN_ROWS labelled documents, those
with the smallest hash of doc_id.  The bound holds at every size of corpus;
the model is some 100 KB.  Scoring reads every whole text.

Defined results: null and empty texts get the score of no terms; a null
doc_id isn't held out and never trained on; a document with several labels
trains with the largest; without labels of both kinds every score is the share
of label 1; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .words import lean, ship

#: At most so many labelled documents are trained on.
TRAIN_ROWS = 20_000
TERMS, COMMON = 1024, 512
FACTORS = 6
PREFIXES = (3, 4, 5)
SLOTS = 1 << 22
#: Passes over the sample; small samples get as many more as make LEAST_STEPS batches.
EPOCHS = 20
LEAST_STEPS = 400
BATCH = 256
RATE = 0.05
DECAY = 1e-5
#: A chosen term stands in so many documents of the sample.
LEAST_DOCS = 3
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”‘’…-_*#|"


def held_out(c: str = "doc_id"):
    """Whether the document is never learnt from: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(c).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def slots_of(word: str) -> tuple[int, ...]:
    w = word.lower().strip(PUNCTUATION)
    if not w:
        return ()
    terms = {w, *(f"{k}^{w[:k]}" for k in PREFIXES if len(w) > k)}
    return tuple(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % SLOTS for t in terms)


class Terms(dict):
    """word -> slots, or their places among the chosen ones; remembers up to `most` words."""

    def __init__(self, chosen: np.ndarray | None = None, most: int = 400_000):
        super().__init__()
        self.place = None if chosen is None else {int(s): i for i, s in enumerate(chosen)}
        self.most = most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        slots = slots_of(word)
        if self.place is not None:
            slots = tuple(self.place[s] for s in slots if s in self.place)
        self[word] = slots
        return slots

    def of(self, text: str | None) -> np.ndarray:
        """The distinct slots of a text, sorted."""
        return np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, set(text.split()))), np.int64)) if text else np.empty(0, np.int64)


@dataclass
class Machine:
    slots: np.ndarray  # the chosen slots
    bias: float
    weight: np.ndarray  # terms
    factor: np.ndarray  # terms x FACTORS

    def margins(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts given by the places of their terms, one after another."""
        return _margins(self.bias, self.weight, self.factor, flat, sizes)[0]

    def scores(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margins(flat, sizes))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; runs may be empty."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _margins(bias, weight, factor, flat, sizes):
    v = factor[flat]
    sums = _sums(v, sizes)
    return bias + _sums(weight[flat], sizes) + 0.5 * ((sums**2).sum(axis=1) - _sums((v**2).sum(axis=1), sizes)), sums, v


def fit(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, slots: np.ndarray, seed: int = 7) -> Machine:
    rng = np.random.default_rng(seed)
    n_terms, share = len(slots), (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.1
    theta = np.zeros((n_terms + 1, FACTORS + 1))
    theta[:-1, 1:] = rng.normal(0, 0.05, (n_terms, FACTORS))
    theta[-1, 0] = np.log(share / (1 - share))
    if n_terms and 0 < y.sum() < len(y):
        first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
        starts = np.cumsum(sizes) - sizes
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(y)))):
            order = rng.permutation(len(y))
            for a in range(0, len(y), BATCH):
                rows = order[a : a + BATCH]
                size = sizes[rows]
                at = flat[np.repeat(starts[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                margin, sums, v = _margins(theta[-1, 0], theta[:-1, 0], theta[:-1, 1:], at, size)
                slope = (_sigmoid(margin) - y[rows]) / len(rows)
                each = np.repeat(slope, size)
                grad = np.zeros_like(theta)
                grad[:-1, 0] = np.bincount(at, each, n_terms)
                pull = each[:, None] * (np.repeat(sums, size, axis=0) - v)
                for f in range(FACTORS):
                    grad[:-1, f + 1] = np.bincount(at, pull[:, f], n_terms)
                grad[:-1] += DECAY * theta[:-1]
                grad[-1, 0] = slope.sum()
                step += 1
                first += 0.1 * (grad - first)
                second += 0.01 * (grad**2 - second)
                theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Machine(slots, float(theta[-1, 0]), theta[:-1, 0].copy(), theta[:-1, 1:].copy())


def _labelled_slots(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """label, slots of the sample."""
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    def run(batches):
        terms = Terms()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([terms.of(x).astype(np.int32) for x in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["label", "slots"])

    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("label").cast("int").alias("label"), "text").mapInArrow(lean(run), "label int, slots array<int>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    ship(docs.sparkSession)
    sample = materialise(_labelled_slots(docs, labels, rows), "labelled")

    def count(batches):
        has = np.zeros((2, SLOTS), np.int32)
        for batch in batches:
            for label, slots in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                has[int(label == 1), slots.values.to_numpy()] += 1
        used = np.flatnonzero(has.any(axis=0))
        for some in np.array_split(used, max(1, len(used) // 50_000)):
            yield pa.RecordBatch.from_pydict({"slot": some.astype(np.int64), "off": has[0, some].astype(np.int64), "on": has[1, some].astype(np.int64)})

    totals = dict(sample.groupBy("label").count().collect())
    n1 = totals.get(1, 0)
    n0 = sum(totals.values()) - n1
    on, off = F.col("on").cast("double"), F.col("off").cast("double")
    chi = F.pow(on * n0 - off * n1, F.lit(2.0)) * (n0 + n1) / ((on + off) * (n0 + n1 - on - off + 1.0) * max(1, n0 * n1))
    counts = sample.mapInArrow(lean(count), "slot long, off long, on long").groupBy("slot").agg(F.sum("off").alias("off"), F.sum("on").alias("on"))
    counts = materialise(counts.filter(F.col("on") + F.col("off") >= LEAST_DOCS), "term-counts")
    telling, common = counts.orderBy(chi.desc(), "slot").limit(TERMS), counts.orderBy((on + off).desc(), "slot").limit(COMMON)
    slots = np.array(sorted({r["slot"] for r in [*telling.select("slot").collect(), *common.select("slot").collect()]}), np.int64)

    def places(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                found = x.values.to_numpy().astype(np.int64)
                at = np.searchsorted(slots, found)
                out.append(at[(at < len(slots)) & (slots[np.minimum(at, len(slots) - 1)] == found)].astype(np.int32) if len(slots) else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["label", "places"])

    got = sample.mapInArrow(lean(places), "label int, places array<int>").toArrow()
    lists = got.column("places").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.empty(0, np.int64)
    # the order of rows must not depend on tasks
    y = (np.asarray(got.column("label")) == 1).astype(float)
    flat = np.asarray(lists.flatten()).astype(np.int64)
    keys = [(int(y[i]), flat[a : a + n].tobytes()) for i, (a, n) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True))]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in order]) if order else flat
    return fit(flat, sizes[order].astype(np.int64), y[order], slots)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship(docs.sparkSession)

    def run(batches):
        terms = Terms(machine.slots)
        for batch in batches:
            lists = [terms.of(x) for x in batch.column(2).to_pylist()]
            s = machine.scores(np.concatenate(lists) if lists else np.empty(0, np.int64), np.fromiter(map(len, lists), np.int64, len(lists)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op2_toxicity_factors(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
