"""Decisions: the four-state judge, its effects, verdicts and tallies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import ordered_distinct, same_flat

RIGHT, DOUBTFUL, WRONG = "正確", "存疑", "錯字"


def outcome(candidate: Column, hit: Column, parsed: Column, abandon: Column, xling: Column, common: Column) -> Column:
    """fix, keep or manual.

    Without a candidate or a readable answer: keep.  Without a hit and without
    support from a parallel text the candidate counts as abandoned.  A hit is
    fixed, but a common original word goes to a human.
    """
    gone = abandon | (~hit & ~xling)
    return F.when(candidate.isNull() | ~F.coalesce(parsed, F.lit(False)) | gone, "keep").when(hit & ~common, "fix").otherwise("manual")


def effects(result: Column, candidate: Column, current: Column, history: Column) -> Column:
    """struct(review, decision, correct, history): what an outcome does to a span."""
    item = F.struct((F.size(history) + 1).alias("iter"), candidate.alias("value"), F.lit("model").alias("by"))
    longer = F.when((result == "fix") & ~candidate.eqNullSafe(current), F.array_append(history, item)).otherwise(history)
    return F.struct(
        F.when(result == "fix", WRONG).when(result == "manual", DOUBTFUL).otherwise(RIGHT).alias("review"),
        F.when(result == "fix", "auto").when(result == "manual", "human").otherwise("pending").alias("decision"),
        F.when(result.isin("fix", "manual"), candidate).alias("correct"),
        longer.alias("history"),
    )


def pending(spans: DataFrame) -> DataFrame:
    """Spans that a judge still has to see."""
    return spans.filter((F.col("review") == DOUBTFUL) & (F.col("decision") != "human"))


def judge(spans: DataFrame, answer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pending spans judged and put back, others as they are.

    ``answer`` adds parsed, abandon and xling to the pending spans; without it
    every one is kept.
    """
    open_spans = pending(spans)
    seen = answer(open_spans) if answer else open_spans.withColumns({"parsed": F.lit(False), "abandon": F.lit(True), "xling": F.lit(False)})
    result = outcome(F.col("candidate"), F.col("rule_hit"), F.col("parsed"), F.col("abandon"), F.col("xling"), F.col("common"))
    new = seen.select("span_id", result.alias("outcome"), effects(result, F.col("candidate"), F.get(F.col("history"), F.size("history") - 1)["value"], F.col("history")).alias("e"))
    return spans.join(new, "span_id", "left").select(
        *[F.coalesce(F.col(f"e.{c}"), F.col(c)).alias(c) if c in ("review", "decision", "correct", "history") else F.col(c) for c in spans.columns], "outcome"
    )


def severity(review: Column) -> Column:
    return F.when(review == WRONG, 3).when(review == DOUBTFUL, 2).when(review == RIGHT, 1)


def verdicts(spans: DataFrame, key: str = "seg_id") -> DataFrame:
    """key, verdict: the worst review in it, right when none is known."""
    worst = F.max(severity(F.col("review")))
    return spans.groupBy(key).agg(F.when(worst == 3, WRONG).when(worst == 2, DOUBTFUL).otherwise(RIGHT).alias("verdict"))


def tally(judged: DataFrame, key: str) -> DataFrame:
    """key, candidates, fix, keep, manual; keys without candidates are left out."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return judged.filter("candidate is not null").groupBy(key).agg(F.count("*").alias("candidates"), n("fix"), n("keep"), n("manual"))


def manual_queue(spans: DataFrame) -> DataFrame:
    """Span ids that wait for a human."""
    return spans.filter(F.col("decision") == "human").select("span_id")


def span_words(history: Column, candidates: Column, glyphs: dict[str, str] | None = None) -> Column:
    """struct(original, candidates): the first model value, and other distinct suggestions."""
    current = F.get(history, F.size(history) - 1)["value"]
    original = F.coalesce(F.get(F.filter(history, lambda h: h["by"] == "model"), F.lit(0))["value"], current, F.lit(""))
    offered = F.filter(F.concat(F.array(current), F.coalesce(candidates, F.array().cast("array<string>"))), lambda c: c.isNotNull() & (c != "") & ~same_flat(c, original, glyphs))
    return F.struct(original.alias("original"), ordered_distinct(offered, glyphs).alias("candidates"))


def patch_spans(spans: DataFrame, patches: DataFrame) -> DataFrame:
    """Human edits: a new value goes to the history, other given fields replace the old ones."""
    p = patches.select("span_id", *[F.col(c).alias(f"__{c}") for c in patches.columns if c != "span_id"])
    given = {c[2:] for c in p.columns if c.startswith("__")}
    joined = spans.join(p, "span_id", "left")
    out = []
    for c in spans.columns:
        if c == "history" and "value" in given:
            item = F.struct((F.size("history") + 1).alias("iter"), F.col("__value").alias("value"), F.lit("human").alias("by"))
            out.append(F.when(F.col("__value").isNotNull(), F.array_append("history", item)).otherwise(F.col("history")).alias(c))
        else:
            out.append(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in given else F.col(c))
    return joined.select(*out)


def replace_segments(old: DataFrame, new: DataFrame, targets: DataFrame) -> DataFrame:
    """Spans of the target segments replaced by new ones."""
    return old.join(targets.select("seg_id").distinct(), "seg_id", "left_anti").unionByName(new)
