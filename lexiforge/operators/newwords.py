"""New words by n-gram statistics: frequency, cohesion and branching entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.written import cut


def ngrams(runs: DataFrame, most: int = 6) -> DataFrame:
    """w, l, r: every substring of up to ``most`` characters of each run with its neighbours, ^ and $ at the ends."""
    n = F.length("run")
    spots = runs.select("run").filter(n > 0).withColumn("i", F.explode(F.sequence(F.lit(1), n)))
    sized = spots.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), n - F.col("i") + 1))))
    return sized.select(
        F.substring(F.col("run"), F.col("i"), F.col("n")).alias("w"),
        F.when(F.col("i") > 1, F.substring(F.col("run"), F.col("i") - 1, F.lit(1))).otherwise("^").alias("l"),
        F.when(F.col("i") + F.col("n") <= n, F.substring(F.col("run"), F.col("i") + F.col("n"), F.lit(1))).otherwise("$").alias("r"),
    )


def folded(grams: DataFrame) -> DataFrame:
    """w, l, r, c: each n-gram between its neighbours once, with its number of occurrences."""
    return grams.groupBy("w", "l", "r").agg(F.count("*").alias("c"))


def counts(grams: DataFrame) -> DataFrame:
    """w, n: occurrences of each n-gram, from rows that may be folded."""
    return grams.groupBy("w").agg((F.sum("c") if "c" in grams.columns else F.count("*")).alias("n"))


def branch_entropy(grams: DataFrame) -> DataFrame:
    """w, left, right, entropy: of the neighbour distributions on both sides, and the smaller one; rows may be folded."""

    def side(col: str) -> DataFrame:
        n = grams.groupBy("w", col).agg((F.sum("c") if "c" in grams.columns else F.count("*")).alias("c"))
        # -sum(p ln p) = ln t - sum(c ln c) / t, in one pass
        return n.groupBy("w").agg((F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c")).alias(f"h_{col}"))

    return side("l").join(side("r"), "w").select("w", F.col("h_l").alias("left"), F.col("h_r").alias("right"), F.least("h_l", "h_r").alias("entropy"))


def cohesion(counted: DataFrame, total: int, least_count: int = 1) -> DataFrame:
    """w, n, cohesion: ln of the probability over the best product of a split's parts."""
    long = counted.filter((F.length("w") >= 2) & (F.col("n") >= least_count))
    split = long.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("w") - 1))).select("w", "n", F.substring(F.col("w"), F.lit(1), F.col("i")).alias("a"), F.substring(F.col("w"), F.col("i") + 1, F.length("w")).alias("b"))
    a, b = counted.select(F.col("w").alias("a"), F.col("n").alias("na")), counted.select(F.col("w").alias("b"), F.col("n").alias("nb"))
    best = split.join(a, "a").join(b, "b").groupBy("w", "n").agg(F.max((F.col("na") / total) * (F.col("nb") / total)).alias("joint"))
    return best.select("w", "n", F.ln((F.col("n") / total) / F.col("joint")).alias("cohesion"))


def discover(runs: DataFrame, most: int = 6, least_count: int = 3, least_cohesion: float = 1.8, least_entropy: float = 0.8, top: int = 800) -> DataFrame:
    """term, confidence, freq, score, source of new words, fragments suppressed, the best ``top``."""
    total = runs.agg(F.coalesce(F.sum(F.length("run")), F.lit(0)).alias("t")).first()["t"]
    if not total:
        return runs.sparkSession.createDataFrame([], "term string, confidence double, freq bigint, score double, source string")
    grams = cut(folded(ngrams(runs, most)))
    found = cohesion(counts(grams), total, least_count).filter(F.col("cohesion") >= least_cohesion).join(branch_entropy(grams), "w").filter(F.col("entropy") >= least_entropy)
    scored = found.select(F.col("w").alias("term"), F.round(F.least(F.lit(1.0), 0.35 + 0.08 * F.col("cohesion") + 0.12 * F.col("entropy")), 3).alias("confidence"), F.col("n").alias("freq"), F.round(F.col("cohesion") + F.col("entropy"), 3).alias("score"))
    # read once for each length
    return suppress_fragments(cut(scored), most).orderBy(F.desc("score"), "term").limit(top).withColumn("source", F.lit("newword"))


def suppress_fragments(scored: DataFrame, most: int = 6, rounds: int = 64) -> DataFrame:
    """Drop a term inside a kept, better-scored term that is nearly as frequent.

    Whether a term is kept depends only on better terms that contain it, which
    are strictly longer, so the decision is settled length by length: for each
    length one join of the terms with the pieces of the kept longer ones.
    """
    order = F.struct(-F.col("score"), "term")
    rows = scored.withColumn("order", order).withColumn("len", F.length("term"))
    kept = rows.filter(F.col("len") >= most)
    for size in range(min(most - 1, rounds), 0, -1):
        longer = kept.select(F.col("order").alias("k_order"), F.floor(F.col("freq") * 1.2).alias("k_most"), F.col("term").alias("k_term"))
        inside = longer.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("k_term") - size + 1))).select(F.substring(F.col("k_term"), F.col("i"), F.lit(size)).alias("part"), "k_order", "k_most").distinct()
        here = rows.filter(F.col("len") == size)
        bad = here.join(inside, (F.col("term") == F.col("part")) & (F.col("k_order") < F.col("order")) & (F.col("freq") <= F.col("k_most"))).select("term").distinct()
        # read twice by the next length: written, so that plans don't double
        kept = kept.unionByName(cut(here.join(bad, "term", "left_anti").select(kept.columns)))
    return kept.drop("order", "len")


def best_confidence(rows: DataFrame) -> DataFrame:
    """term, source, confidence: the most confident row of each term, the first by ``ord`` on ties."""
    return rows.groupBy("term").agg(F.min_by(F.struct("source", "confidence"), F.struct(-F.col("confidence"), "ord")).alias("b")).select("term", "b.source", "b.confidence")


def listed_terms(lines: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Terms of a hand-made list: one a line, # for comments."""
    t = F.trim("value")
    return lines.select(t.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#")).distinct().select("term", F.lit("manual").alias("source"), F.lit(confidence).alias("confidence"))
