"""Entities from tagged tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import keep_entity, strip


def decode_bioes(tokens: DataFrame, key: str = "doc", pos: str = "pos", texts: DataFrame | None = None) -> DataFrame:
    """key, start, end, type, score from rows (key, pos, tag, start, end, score).

    B and S open an entity; I and E carry on one of the same type that is still
    open, else they open one; E, S and O close.  A type may have hyphens.  The score
    is the lowest.  With ``texts`` (key, text) entities get their surface, and blank ones go.
    """
    order = Window.partitionBy(key).orderBy(pos)
    place, kind = F.regexp_extract("tag", "^([^-]*)-", 1), F.when(F.col("tag").contains("-"), F.regexp_extract("tag", "^[^-]*-(.*)$", 1))
    t = tokens.withColumn("place", F.when(kind.isNull(), "O").otherwise(place)).withColumn("type", kind)
    before, type_before = F.lag("place").over(order), F.lag("type").over(order)
    goes_on = F.col("place").isin("I", "E") & before.isin("B", "I") & (F.col("type") == type_before)
    t = t.withColumn("opens", (F.col("place") != "O") & ~F.coalesce(goes_on, F.lit(False)))
    t = t.filter("place <> 'O'").withColumn("n", F.sum(F.col("opens").cast("int")).over(order))
    found = t.groupBy(key, "n").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("type").alias("type"), F.round(F.min("score"), 4).alias("score")).drop("n")
    if texts is None:
        return found
    surface = strip(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
    return found.join(texts.select(key, "text"), key).withColumn("surface", surface).filter("surface <> ''").drop("text")


def useful_entities(entities: DataFrame, seen: DataFrame | None = None, key: str = "seg_id") -> DataFrame:
    """Entities that are no numbers or times, once for each surface, without those already seen."""
    kept = entities.filter(keep_entity(F.col("surface"), F.col("type")))
    first = kept.withColumn("n", F.row_number().over(Window.partitionBy(key, "surface").orderBy("start"))).filter("n = 1").drop("n")
    return first.join(seen.select(key, "surface"), [key, "surface"], "left_anti") if seen is not None else first
