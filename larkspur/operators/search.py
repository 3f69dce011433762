"""Search over texts: an inverted index for full-text queries, and trigram candidates for LIKE and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.textsearch import ts_match, vector
from larkspur.functions.trigrams import show_trgm, similarity


def inverted_index(df: DataFrame, key: str, text: str, config: str = "simple") -> DataFrame:
    """lexeme, key: one row for each lexeme of each text."""
    lexemes = F.udf(lambda t: [e["lexeme"] for e in vector(t, config)] if t else [], "array<string>", useArrow=True)
    return df.select(F.explode(lexemes(F.col(text))).alias("lexeme"), F.col(key))


def words_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """inverted_index of plain words in lower case, without Python."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return df.select(F.explode(words).alias("lexeme"), F.col(key))


def all_of(index: DataFrame, key: str, lexemes: list[str]) -> DataFrame:
    """Keys whose texts hold every lexeme: the intersection of posting lists by counting."""
    wanted = sorted(set(lexemes))
    return index.filter(F.col("lexeme").isin(wanted)).groupBy(key).agg(F.count_distinct("lexeme").alias("_n")).filter(F.col("_n") == len(wanted)).select(key)


def matching(df: DataFrame, vector_column: str, query: str) -> DataFrame:
    """Rows whose vector matches a query."""
    return df.filter(ts_match(F.col(vector_column), F.lit(query)))


def similar(df: DataFrame, text: str, to: str, least: float = 0.3) -> DataFrame:
    """Rows whose text is similar to a given one, with the similarity; texts of hopeless length go first."""
    grams = F.size(show_trgm(F.col(text)))
    own = F.size(show_trgm(F.lit(to)))
    possible = F.least(grams, own) / F.greatest(grams, own) >= least - 1e-6
    return df.filter(possible).withColumn("similarity", similarity(F.col(text), F.lit(to))).filter(F.col("similarity") >= F.lit(least).cast("float"))
