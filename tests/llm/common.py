"""Fixtures that all the operators' tests share: awkward rows and brute-force helpers."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


LONG = " ".join(f"word{i % 997}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))
PLAIN = "The quick brown fox jumps over the lazy dog while seven wise owls look on from a tree near the old stone bridge"


def awkward_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rows = [
        (1, PLAIN, "en", "a", 10),
        (2, PLAIN, "en", "b", 10),
        (2, PLAIN, "en", "b", 10),
        (3, None, "en", "a", None),
        (4, "", "de", None, 0),
        (5, " \t\n ", None, "a", 4),
        (6, LONG, "en", "a", len(LONG)),
        (7, "one two three", "en", "c", 13),
        (8, "one two three", "en", "c", 13),
        (9, "intro words here " + PASSAGE + " outro words", "en", "b", 5),
        (10, "another opening " + PASSAGE + " and a different end", "en", "é", 5),
        (11, PASSAGE + " " + PASSAGE, "en", "b", 5),
        (12, "été ßtraße  nbsp sep 日本語 " + PLAIN.upper(), "fr", "z", 7),
        (13, "a " * 300, "en", "a", 600),
        (14, "### $$$ %%% " * 30, "en", "c", 600),
        (None, PLAIN + " extra", None, None, None),
        (None, None, None, None, None),
    ]
    for i in range(20, 60):
        rows.append((i, " ".join(f"w{(i * 7 + j * j) % 211}" for j in range(i * 3)), "en", f"s{i % 4}", i))
    return rows


def awkward(spark, extra=False):
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    if extra:  # extra columns with clashing names
        from pyspark.sql import functions as F

        for name in ("size", "bucket", "shard", "key", "fp", "_key", "w", "target", "row", "start", "kept", "bytes"):
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
