from collections import Counter

from larkspur.llm import quality as q

from .common import awkward, awkward_rows, empty, words


def brute(text):
    w = words(text)
    text = text or ""
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n, chars, symbols = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text)
    base = n < 10 or 100 * len(covered) > 20 * n
    kept = not (base or 10 * symbols > n or 2 * text.count("!") > n or chars < 2 * n or chars > 15 * n or 2 * dup > len(lines))
    return n, chars, symbols, dup, len(covered), base, kept


def rows_of(df):
    return Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in df.collect())


def test_awkward_rows(spark):
    rows = [*awkward_rows(), (90, "same line of words\n" * 9, "en", "a", 1), (91, "\n".join(f"line {i} of many words here" for i in range(9)) + "\x1cx y", "en", "a", 1), (92, "shout!! " * 3 + "calm " * 2, "en", "a", 1)]
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    assert rows_of(q.judge(docs)) == Counter((r[0], *brute(r[1])) for r in rows)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert rows_of(q.op7_quality_cascade(spark, sf_dir)) == Counter((r.doc_id, *brute(r.text)) for r in rows)


def test_filter_keeps_columns_and_order_does_not_matter(spark):
    docs = awkward(spark, extra=True)
    kept = q.filter_documents(docs)
    assert kept.columns == docs.columns
    want = Counter(r[0] for r in awkward_rows() if brute(r[1])[-1])
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert Counter(r.doc_id for r in q.filter_documents(docs, q.RULES[::-1]).collect()) == want


def test_plan_orders_by_rejections_per_second():
    m = [q.Measured("too_short", 2.0, 10, 100), q.Measured("symbols", 0.1, 9, 100), q.Measured("word_length", 0.1, 0, 100)]
    rules = [r for r in q.RULES if r.name in {x.name for x in m}]
    assert [r.name for r in q.plan(m, rules)] == ["symbols", "too_short", "word_length"]


def test_facts_are_lazy():
    f = q.Facts("a few words", q.Hashes())
    assert q.first_rejection(f, list(q.RULES)) == "too_short"
    assert "n_repeat_words" not in f.__dict__ and "n_symbols" not in f.__dict__


def test_empty(spark):
    assert q.judge(empty(spark)).count() == 0
    assert q.filter_documents(empty(spark)).count() == 0
