import zlib
from collections import defaultdict

import numpy as np
import pytest

from larkspur.llm import token_shards as t
from larkspur.llm.common import scratch

from .common import awkward, awkward_rows, empty

TRICKY = ["a  b", " lead", "trail ", "x \n y", "tab\tbed", "a b c", "it's we'll 12 3abc", "\n\n  \n", "é ü", "日本 語", "a   b", "don 't", "9 9 9", "!? !?", "\x1c a \x1d b", "one two.\nthree, four!\nfive's six' 'tis 7th ½ x² a_b", "ends.\n", "a\n\nb"]


@pytest.fixture(scope="module")
def tokenizer():
    return t.Tokenizer()


@pytest.mark.parametrize("text", TRICKY + [r[1] or "" for r in awkward_rows()])
def test_encoding_round_trip(tokenizer, text):
    plain = tokenizer._encoding.encode_ordinary(text)
    assert tokenizer.encode(text).tolist() == plain
    assert tokenizer.decode(tokenizer.encode(text)) == text


@pytest.mark.parametrize("n", [1, 2, 3, 10, 255, 256, 257, 5000])
def test_feistel_is_a_permutation(n):
    out = t.feistel(np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n))
    if n > 200:
        assert (out != t.feistel(np.arange(n), n, key=1)).any() and abs(np.corrcoef(np.arange(n), out)[0, 1]) < 0.2


def brute(rows, tokenizer, sequence):
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer._encoding.encode_ordinary(text or ""), t.END]
        for part in range(0, len(ids), sequence):
            x = np.array(ids[part : part + sequence], np.uint16)
            out.append((doc_id, part // sequence, len(x), zlib.crc32(x.tobytes())))
    return out


def test_shards_hold_every_sequence_once(spark, tokenizer):
    docs = awkward(spark, extra=True).repartition(3)
    shards = t.write_shards(docs, scratch(spark, "tokens"), sequence=16, shard=50)
    got = t.read_shards(spark, shards, sequence=16).collect()
    want = brute([(r[0], r[1]) for r in awkward_rows()], tokenizer, 16)
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.part, r.n_tokens, r.tokens_crc32) for r in got), key=key) == sorted(want, key=key)
    assert sorted(r.slot for r in got) == list(range(len(want)))
    meta = sorted(shards.collect(), key=lambda r: r.shard)
    assert len(meta) > 3 and [r.first_slot for r in meta] == [sum(x.records for x in meta[:i]) for i in range(len(meta))]
    of = {r.shard: r for r in meta}
    assert all(of[r.shard].first_slot <= r.slot < of[r.shard].first_slot + of[r.shard].records for r in got)
    # resuming at a place reads what lies from there on
    one = max(meta, key=lambda r: r.records).path
    whole = np.concatenate(list(t.read_from(one, 0, 16)))
    assert (np.concatenate(list(t.read_from(one, 11, 16, 5))) == whole[11:]).all()
    # the order is that of the permuted numbers
    longest = max(len((r[1] or "").encode()) for r in awkward_rows())
    parts, most = longest // 16 + 1, max(r[0] or 0 for r in awkward_rows())
    place = lambda r: t.feistel(np.array([(most - 1 + 1 if r.doc_id is None else r.doc_id - 1) * parts + r.part]), (most - 1 + 2) * parts)[0]
    places = [place(r) for r in sorted(got, key=lambda r: r.slot)]
    assert places == sorted(places)


def test_texts_come_back(spark, tokenizer):
    rows = [(i, x) for i, x in enumerate(TRICKY)]
    shards = t.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark, "tokens"), sequence=4, shard=7)
    parts = defaultdict(dict)
    for r in shards.collect():
        for x in np.concatenate(list(t.read_from(r.path, 0, 4))):
            parts[int(x["doc_id"])][int(x["part"])] = x["ids"][: x["n"]].tolist()
    for i, text in rows:
        ids = [j for p in sorted(parts[i]) for j in parts[i][p]]
        assert ids[-1] == t.END and tokenizer.decode(ids[:-1]) == text


def test_reruns_agree(spark, sf_dir):
    a, b = (sorted(map(tuple, t.op4_token_shards(spark, sf_dir).collect())) for _ in range(2))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    c = sorted(map(tuple, t.read_shards(spark, t.write_shards(docs, scratch(spark, "tokens"))).collect()))
    assert a == b == c and [x[0] for x in a] == list(range(len(a)))


def test_empty(spark):
    assert t.read_shards(spark, t.write_shards(empty(spark), scratch(spark, "tokens"))).count() == 0


def test_widest_ids_and_null(spark, tokenizer):
    """Ids at both ends of their type, as hashes have them; the order is still that of the permuted numbers."""
    rows = [(-(2**63), "the least"), (2**63 - 1, "the most " * 40), (0, "nought"), (None, "none"), (-(2**62), ""), (2**62, None)]
    rows += [(int(x), "some words here " * 9) for x in np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 40)]
    shards = t.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch(spark, "tokens"), sequence=8, shard=20)
    got = sorted(t.read_shards(spark, shards, sequence=8).collect(), key=lambda r: r.slot)
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.part, r.n_tokens, r.tokens_crc32) for r in got), key=key) == sorted(brute(rows, tokenizer, 8), key=key)
    least, parts = -(2**63), max(len((x or "").encode()) for _, x in rows) // 8 + 1
    n = (2**64 + 1) * parts
    number = lambda r: (2**64 if r.doc_id is None else r.doc_id - least, r.part)
    assert n > 2**64 and t.half_bits(n) > 32
    places = []
    for r in got:
        if r.doc_id is not None:
            base, part = number(r)
            left, right = t.feistel_halves(*t.halves(np.array([base], np.uint64), parts, np.array([part]), n), n)
            assert (base * parts + part) == (int(t.halves(np.array([base], np.uint64), parts, np.array([part]), n)[0][0]) << t.half_bits(n)) + int(t.halves(np.array([base], np.uint64), parts, np.array([part]), n)[1][0])
            places.append((int(left[0]), int(right[0])))
    assert places == sorted(places)


@pytest.mark.parametrize("text", [" " * 5_000_000, "a" + "\n" * 1_000_001 + "b", "x " + " \t" * 600_000 + " y z", "w" * 1_000_000, " " * 100_001, " " * 100_002 + "a"])
def test_very_long_runs(tokenizer, text):
    assert tokenizer.decode(tokenizer.encode(text)) == text
