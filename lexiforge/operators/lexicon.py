"""Word frequencies and common words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMON_PER_MILLION = 10.0


def words_of(rows: DataFrame, text_col: str = "text", least: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """word: every lower-case ASCII word of ``least`` letters or more."""
    return rows.select(*keep, F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"([a-z]{{{least},}})"), F.lit(1))).alias("word"))


def frequencies(words: DataFrame) -> DataFrame:
    """word, n, per_million over all words."""
    n = words.groupBy("word").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select("word", "n", F.round(F.col("n") * 1e6 / F.col("total"), 4).alias("per_million"))


def common_words(freq: DataFrame, least: float = COMMON_PER_MILLION) -> DataFrame:
    return freq.filter(F.col("per_million") >= least).select("word")
