"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target number of words.  Its documents, in an order set by
a hash, get virtual finish times: the source's cumulative words divided by its
target.  All documents of all sources are then taken in the order of their
finish times until the total budget is spent.  A second pass over a source's
documents follows the first when its target is above its size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources in order of code point, null last, have ``weights`` in turn and
    divide ``share`` of all words; no target passes ``most`` times its source's
    size, and what is cut there is divided again by weight.  That ends where
    target = min(cap, level * weight) for one level, found from the running
    sums in the order of cap / weight.  The table has one row for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    w = w.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    w = (
        w.withColumn("cap_before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("weight_from", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level_here", (F.col("budget") - F.col("cap_before")) / F.col("weight_from"))
    )
    # the first source in this order that its cap does not stop sets the level
    first = F.min(F.when(F.col("level_here") <= F.col("ratio"), F.struct("place", "level_here"))).over(everything)
    w = w.withColumn("place", F.row_number().over(by_ratio)).withColumn("level", first["level_here"])
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"), "budget")


def _order_hash(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def sums_before(groups: DataFrame, of: list[str], place: str, high: Column, size: str) -> DataFrame:
    """``groups`` with ``before``: the sum of ``size`` over the groups of earlier ``place`` in the same ``of``.

    ``high`` is the leading part of ``place``: first the parts are summed up, then
    the places inside each, so that no task orders more than the root of their number.
    """
    groups = groups.withColumn("high", high)
    parts = groups.groupBy(*of, "high").agg(F.sum(size).alias("part_size"))
    parts = parts.withColumn("part_before", F.sum("part_size").over(Window.partitionBy(*of).orderBy("high")) - F.col("part_size")).drop("part_size")
    inside = F.sum(size).over(Window.partitionBy(*of, "high").orderBy(place)) - F.col(size)
    p, g = parts.alias("p"), groups.withColumn("inside", inside).alias("g")
    same = F.col("p.high") == F.col("g.high")
    for c in of:
        same &= F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}"))
    return g.join(p, same).select("g.*", (F.col("part_before") + F.col("inside")).alias("before")).drop("high", "inside")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, rows_in_group: int = 50_000) -> DataFrame:
    """doc_id, size, source_size, target, taken for each input row.

    ``taken`` is 0, once or twice the document's size: whole documents only, so
    a source's sum differs from its target by less than one document.  Null
    texts have size 0 and take nothing; null sources form one source; repeated
    ids are ordered by size; an empty table gives an empty result.

    Running sums are split into groups of about ``rows_in_group`` rows: a source
    by leading digits of the order hash, the queue by finish time; sums over the
    groups give each its offset.  No group grows with the input.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text_col).alias("text_hash")))
    sources = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    n_rows = rows.count()
    digits = 1
    while 16**digits * rows_in_group < n_rows and digits < 8:
        digits += 1

    # running sums of each source, in hash order, in two levels
    keyed = rows.withColumn("h", _order_hash(F.col("doc_id"), seed)).withColumn("g", F.substring("h", 1, digits + 1))
    in_group = Window.partitionBy("source", "g").orderBy("h", "doc_id", "size", "text_hash")
    groups = keyed.groupBy("source", "g").agg(F.sum("size").alias("g_size"))
    groups = sums_before(groups, ["source"], "g", F.substring("g", 1, (digits + 1) // 2), "g_size")
    k, g, s = keyed.withColumn("within", F.sum("size").over(in_group.rowsBetween(Window.unboundedPreceding, 0))).alias("k"), groups.alias("g"), sources.alias("s")
    placed = (
        k.join(g, F.col("k.source").eqNullSafe(F.col("g.source")) & (F.col("k.g") == F.col("g.g")))
        .join(s, F.col("k.source").eqNullSafe(F.col("s.source")))
        .select("k.doc_id", "k.size", "k.h", "k.text_hash", "s.source_size", "s.target", "s.budget", (F.col("before") + F.col("within")).alias("cum"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    placed = cut(placed)
    passes = F.array(*[F.lit(p) for p in range(int(most))])
    finish = (F.col("cum") + F.col("pass") * F.col("source_size")) / F.col("target")
    items = placed.filter((F.col("size") > 0) & (F.col("target") > 0)).withColumn("pass", F.explode(passes)).withColumn("finish", finish)

    # the queue: bins of finish time; words before each bin; exact order inside
    bins = max(256, 16**digits)
    items = items.withColumn("bin", F.floor(F.col("finish") * bins))
    per_bin = items.groupBy("bin").agg(F.sum("size").alias("bin_size"))
    root = math.isqrt(bins)
    per_bin = sums_before(per_bin, [], "bin", F.floor(F.col("bin") / root), "bin_size").withColumnRenamed("before", "bin_before")
    live = items.join(per_bin, "bin").filter(F.col("bin_before") < F.col("budget"))
    queue = Window.partitionBy("bin").orderBy("finish", "h", "doc_id", "size", "pass", "text_hash", "row").rowsBetween(Window.unboundedPreceding, 0)
    taken = live.withColumn("spent", F.col("bin_before") + F.sum("size").over(queue)).filter(F.col("spent") <= F.col("budget"))
    per_row = taken.groupBy("row").agg(F.sum("size").alias("taken"))
    return placed.join(per_row, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "text_hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Rows repeated with one id and text are all taken as often as the one taken most.
    """
    times = mix(docs, id_col, text_col, **options).filter("taken > 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), (F.col("taken") / F.col("size")).cast("int").alias("n"))
    times = times.groupBy("id", "hash").agg(F.max("n").alias("n"))
    rows = docs.select(F.struct("*").alias("doc"))
    doc = F.col("doc")
    out = rows.join(times, doc[id_col].cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(doc[text_col]) == F.col("hash")))
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")
