import os
from collections import Counter

import corpus_pipeline as c
from larkspur.llm import pieces, quality

from .common import awkward, empty, words
from .test_quality import brute as judged
from .test_sharding_mixing import brute_mix
from .test_simhash import brute_groups, jaccard
from .test_substrings import brute as removed


def brute(rows):
    """(doc_id, text) of every row that reaches the last stage, by brute-force versions of the stages."""
    rows = [r for r in rows if judged(r[1])[-1]]
    lower = [[w.lower() for w in words(r[1])] for r in rows]
    label = brute_groups(rows, lambda i, j: jaccard(lower[i], lower[j]) >= 0.8)
    first = {}
    for r, k in zip(rows, label):
        first[k] = min(first.get(k, r[0]), r[0])
    rows = [r for r, k in zip(rows, label) if r[0] == first[k]]
    texts = {d: (kept if gone else None) for d, _, gone, kept in removed([(r[0], r[1]) for r in rows])}
    rows = [(r[0], r[1] if texts[r[0]] is None else texts[r[0]], r[2], r[3], r[4]) for r in rows]
    out = []
    for r, (n, _, _, taken) in zip(rows, brute_mix(rows)):
        out += [(r[0], r[1])] * (taken // n if n else 0)
    return out


def test_run_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = Counter(brute(rows))
    voc, got = pieces.vocabulary(), Counter()
    import numpy as np

    for r in c.run(spark, sf_dir).collect():
        if r.sample == 1 and r.n_pieces:
            got[r.doc_id, pieces.decode_bytes(np.array(r.ids), voc).decode()] += 1
    assert got == want and len(want) > 50


def test_stages_keep_columns(spark):
    docs = awkward(spark, extra=True)
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert stage(spark, empty(spark), "").count() == 0
        out.count()
    assert c.STAGES[-1][1](spark, empty(spark), "").count() == 0


def test_stages_call_the_operators():
    assert [k for k, _ in c.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "mix_sources", "to_pieces"]
    assert os.path.basename(quality.__file__) == "quality.py"


def test_near_dedup_equals_exact_jaccard(spark, sf_dir):
    """The stage keeps the first document of each group linked by a Jaccard similarity of 0.8 or more, and every other document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, [w.lower() for w in words(r.text)]) for r in docs.select("doc_id", "text").collect()]
    label = brute_groups(rows, lambda i, j: min(len(rows[i][1]), len(rows[j][1])) >= 0.5 * max(len(rows[i][1]), len(rows[j][1])) and jaccard(rows[i][1], rows[j][1]) >= 0.8)
    first = {}
    for r, k in zip(rows, label):
        first[k] = min(first.get(k, r[0]), r[0])
    assert sorted(r.doc_id for r in dict(c.STAGES)["near_dedup"](spark, docs, "").collect()) == sorted(first.values())
