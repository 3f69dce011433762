import math
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from larkspur.llm import pieces as p

from .common import awkward, awkward_rows, empty


@pytest.fixture(scope="module")
def voc():
    return p.vocabulary()


def segmentations(text, voc):
    """All segmentations of a short text with their probabilities, by recursion over its characters."""
    s = " " + text
    known = {voc.bytes_of[i].decode("utf-8", "ignore"): i for i in range(259, voc.size)}

    def rest(at):
        if at == len(s):
            yield (), 0.0
            return
        steps = [(at + n, (known[s[at : at + n]],)) for n in range(1, voc.depth + 1) if at + n <= len(s) and s[at : at + n] in known]
        if s[at] not in known:
            steps.append((at + 1, tuple(int(voc.byte_id[b]) for b in s[at].encode())))
        for end, ids in steps:
            for more, w in rest(end):
                yield ids + more, w + sum(voc.log_weight[voc.byte_id[0]] if i in voc.byte_id else voc.log_weight[i] for i in ids)

    every = dict(rest(0))
    total = math.log(sum(map(math.exp, every.values())))
    return {k: v - total for k, v in every.items()}


@pytest.mark.parametrize("text", ["abc", "the\nend", "a  b", "▁x", "é日"])
def test_lattice_holds_every_segmentation(voc, text):
    want = segmentations(text, voc)
    found = p.Group([text], [5], voc).samples(len(want) + 3)[0]
    group = p.Group([text], [5], voc)
    got = {tuple(group.ids(s.edges).tolist()): s for s in found}
    assert len(found) == len(got) and set(got) <= set(want)
    assert len(got) >= 0.9 * len(want)  # those beyond float precision can't be told from no chance
    for k, s in got.items():
        assert s.log_prob == pytest.approx(want[k], abs=1e-9)
    values = [s.value for s in found]
    assert values == sorted(values, reverse=True)
    best = max(want, key=want.get)
    assert tuple(group.ids(group.best()[0]).tolist()) == best


def test_samples_follow_the_distribution(voc):
    """First samples come by probability; pairs as in drawing without replacement."""
    text, n = "lower", 6000
    want = segmentations(text, voc)
    group = p.Group([text] * n, [p.row_key(i) for i in range(n)], voc)
    first, pairs = Counter(), Counter()
    for s in group.samples(2):
        a, b = (tuple(group.ids(x.edges).tolist()) for x in s)
        assert a != b
        first[a] += 1
        pairs[a, b] += 1
    for a, lp in want.items():
        q = math.exp(lp)
        assert abs(first[a] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
    for a, b in permutations(sorted(want, key=want.get)[-4:], 2):
        q = math.exp(want[a] + want[b]) / (1 - math.exp(want[a]))
        assert abs(pairs[a, b] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3


def test_inclusion_scores_weigh_to_one(voc):
    """Sum of p / inclusion over the samples is 1 on average (the estimator that the scores are for)."""
    text, n = "lower the", 4000
    group = p.Group([text] * n, [p.row_key(f"k{i}") for i in range(n)], voc)
    total = np.mean([sum(math.exp(s.log_prob - s.log_inclusion) for s in x) for x in group.samples(3)])
    assert total == pytest.approx(1.0, abs=0.02)


def test_awkward_rows(spark, voc):
    rows = awkward_rows()
    got = p.sample_documents(awkward(spark, extra=True), k=3, with_ids=True).collect()
    assert all(r.round_trip for r in got)
    n = Counter((r.doc_id, r.ids_crc32) for r in got)
    for doc_id in {r[0] for r in rows}:
        assert {r.sample for r in got if r.doc_id == doc_id} <= {1, 2, 3}
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            assert p.decode_bytes(np.array(r.ids, np.int64), voc).decode() == texts[r.doc_id]
    assert max(n.values()) == 2  # only the repeated row draws alike
    assert {r.n_pieces for r in got if r.doc_id in (3, 4)} == {0}
    back = p.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in got if r.doc_id == 12], "doc_id long, ids array<int>"))
    assert {r.text for r in back.collect()} == {texts[12]}


def test_results_do_not_depend_on_batches(spark, monkeypatch, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = sorted(map(tuple, p.op6_gumbel_pieces(spark, sf_dir).collect()))
    monkeypatch.setattr(p, "GROUP_CHARS", 20_000)
    monkeypatch.setattr(p, "STEPS_AT_ONCE", 40)
    b = sorted(map(tuple, p.sample_documents(docs.repartition(5)).collect()))
    assert [x[:4] for x in a] == [x[:4] for x in b]
    assert np.allclose([x[4:6] for x in a], [x[4:6] for x in b], atol=1e-6)
    assert all(x[6] for x in a) and len(a) == 2 * docs.count()


def test_empty(spark):
    assert p.sample_documents(empty(spark)).count() == 0
