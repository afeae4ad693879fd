"""The dictionary: commit with evidence, rule export, edits and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import flatten


def occurrences(spans: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """Distinct occurrences of confirmed corrections, from (batch_id, domain, correct, wrong, context, decision).

    term_id, correct, batch_id, wrong (null where equal to the correct form),
    context, domain.  Repeating a commit adds nothing.
    """
    ok = spans.filter((F.col("decision") == "auto") & (F.coalesce("correct", F.lit("")) != ""))
    return ok.select(F.concat(F.lit("t_"), flatten(F.col("correct"), glyphs)).alias("term_id"), "correct", "batch_id", F.nullif(F.col("wrong"), F.col("correct")).alias("wrong"), "context", "domain").distinct()


def commit(occ: DataFrame, common: DataFrame) -> DataFrame:
    """term_id, correct, variants, domains, n_occurrences, n_batches, confidence.

    Common words never become variants.  Confidence grows with the number of
    distinct batches: 0.5 + 0.1 for each, at most 0.99.
    """
    c = common.select(F.col("word").alias("wrong")).distinct().withColumn("common", F.lit(True))
    rows = occ.join(c, "wrong", "left")
    batches = F.count_distinct("batch_id")
    return rows.groupBy("term_id").agg(
        F.min("correct").alias("correct"),
        F.array_sort(F.collect_set(F.when(F.col("common").isNull(), F.col("wrong")))).alias("variants"),
        F.array_sort(F.collect_set(F.when(F.col("domain") != "", F.col("domain")))).alias("domains"),
        F.count_distinct(F.struct("batch_id", "wrong", "context")).alias("n_occurrences"),
        batches.alias("n_batches"),
        F.round(F.least(F.lit(0.99), 0.5 + 0.1 * batches), 4).alias("confidence"),
    )


def merge_occurrences(old: DataFrame, new: DataFrame) -> DataFrame:
    """All occurrences once: merging the same batch again changes nothing."""
    return old.unionByName(new).distinct()


def export_rules(terms: DataFrame, common: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """kind, pattern, replace, term_id: regex rules, or contextual ones where replacing blindly would harm."""
    rules = terms.select("term_id", F.col("correct").alias("replace"), F.explode("variants").alias("pattern"))
    risky = common.select(F.col("word").alias("key")).union(terms.select(flatten(F.col("correct"), glyphs))).distinct().withColumn("risky", F.lit(True))
    joined = rules.join(risky, flatten(F.col("pattern"), glyphs) == F.col("key"), "left")
    return joined.select(F.when(F.col("risky"), "contextual").otherwise("regex").alias("kind"), "pattern", "replace", "term_id")


def patch_terms(terms: DataFrame, patches: DataFrame) -> DataFrame:
    """Given fields replace the old ones; null leaves them."""
    p = patches.select("term_id", *[F.col(c).alias(f"__{c}") for c in patches.columns if c != "term_id"])
    joined = terms.join(p, "term_id", "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if f"__{c}" in p.columns else F.col(c) for c in terms.columns])


def keep_last(rows: DataFrame, key: str, order: list, most: int = 10) -> DataFrame:
    """The last ``most`` rows of each key: the snapshot stack."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__n", n).filter(F.col("__n") <= most).drop("__n")


def push_snapshot(stack: DataFrame, spans: DataFrame, key: str = "batch_id", most: int = 10) -> DataFrame:
    """The stack with the present spans on top, from (key, seq, spans)."""
    top = stack.groupBy(key).agg(F.max("seq").alias("top"))
    new = spans.join(top, key, "left").select(key, (F.coalesce("top", F.lit(0)) + 1).cast("long").alias("seq"), "spans")
    return keep_last(stack.select(key, F.col("seq").cast("long").alias("seq"), "spans").unionByName(new), key, ["seq"], most)


def pop_snapshot(stack: DataFrame, key: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """(restored spans, the stack without its top)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    ranked = stack.withColumn("__n", n)
    return ranked.filter("__n = 1").drop("__n", "seq"), ranked.filter("__n > 1").drop("__n")
