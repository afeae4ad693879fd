"""Semantic evidence: nearest neighbours, anchors and the rule that joins both axes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions.text import flatten
from lexiforge.functions.vectors import cosine
from lexiforge.operators.blocks import PACK_ROWS, QUERY_BLOCK, against_all, best_rows, matrix, unit
from lexiforge.operators.vector_index import VectorIndex
from lexiforge.written import shared_dir


def knn(queries: DataFrame, cards: DataFrame, k: int | None, floor: float | None = None, block: int = QUERY_BLOCK, pack: int = PACK_ROWS) -> DataFrame:
    """query, card, score, rank: the k cards (None: all from ``floor`` on) nearest to each query vector, both from (id, vec).

    Exact.  Each task keeps only the k best of its cards for a query, and those
    that tie with the last of them, before these are ranked.
    """

    def meet(rows: pa.Table, asked: pa.Table) -> Iterator[pa.Table]:
        q, c = unit(matrix(asked.column("vec"))), unit(matrix(rows.column("vec")))
        for place, of, score in best_rows(len(c), lambda a, b: np.round(q @ c[a:b].T, 6) + 0.0, len(q), len(c) if k is None else k):
            if floor is not None:
                of, score = of[score >= floor], score[score >= floor]
            yield pa.table({"query": asked.column("id").take(pa.array([place] * len(of), pa.int64())), "card": rows.column("id").take(pa.array(of)), "score": score})

    result = T.StructType([T.StructField("query", queries.schema["id"].dataType), T.StructField("card", cards.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    pairs = against_all(cards.select("id", "vec").filter("vec is not null"), queries.select("id", "vec").filter("vec is not null"), meet, result, block, pack)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "card")))
    return ranked.filter(F.col("rank") <= k) if k is not None else ranked


def knn_approximate(queries: DataFrame, cards: DataFrame, k: int, rerank: int | None = None) -> DataFrame:
    """As ``knn``, through a ``VectorIndex`` built for the occasion in the shared folder; an empty table has no neighbours."""
    if cards.isEmpty():
        return knn(queries, cards, k)
    spark = cards.sparkSession
    index = VectorIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", cards.schema["id"].dataType.simpleString()).build(cards)
    return index.search(queries, k, rerank)


def adjacent_similarity(rows: DataFrame, id_col: str, pos_col: str, vec_col: str) -> DataFrame:
    """Each row with ``likeness``: the cosine to the next row of the same id."""
    nxt = F.lead(vec_col).over(Window.partitionBy(id_col).orderBy(pos_col))
    return rows.withColumn("likeness", F.when(nxt.isNotNull(), cosine(F.col(vec_col), nxt)))


def anchors(near: DataFrame, cards: DataFrame, floor: float = 0.35, wiki_floor: float = 0.55, glyphs: dict[str, str] | None = None) -> DataFrame:
    """query, flat, score, source: words that the nearest cards and their pages vouch for.

    near: (query, card, score, rank); cards: (card, term, variants, wiki array of
    (title, aliases, score)).  The first mention counts: by rank of the card, the
    term and its variants before the pages.
    """
    base = near.filter(F.col("score") >= floor).join(cards, "card")
    own = base.select("query", "rank", F.lit(0).alias("side"), F.lit(0).alias("page"), F.posexplode(F.concat(F.array("term"), F.coalesce("variants", F.array().cast("array<string>")))).alias("pos", "word"), F.round("score", 4).alias("score"), F.concat(F.lit("mind:"), F.col("term")).alias("source"))
    pages = base.select("query", "rank", "term", F.posexplode("wiki").alias("page", "w")).filter(F.col("w.score") >= wiki_floor)
    wiki = pages.select("query", "rank", F.lit(1).alias("side"), "page", F.posexplode(F.concat(F.array("w.title"), F.coalesce("w.aliases", F.array().cast("array<string>")))).alias("pos", "word"), F.round("w.score", 4).alias("score"), F.concat(F.lit("wiki:"), F.col("w.title"), F.lit("<"), F.col("term")).alias("source"))
    both = own.unionByName(wiki).filter("word <> ''").withColumn("flat", flatten(F.col("word"), glyphs))
    # dealt out before the window: else each task of the join sorts all its mentions to find the first ones, and a join's row has many
    both = both.repartition("query", "flat")
    first = F.row_number().over(Window.partitionBy("query", "flat").orderBy("rank", "side", "page", "pos"))
    return both.withColumn("n", first).filter("n = 1").select("query", "flat", "score", "source")


def semantic_evidence(candidates: DataFrame, anchor_rows: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """query, candidate, score, source for every candidate; 0 where no anchor holds it."""
    c = candidates.withColumn("flat", flatten(F.col("candidate"), glyphs))
    return c.join(anchor_rows, ["query", "flat"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("source", F.coalesce("source", F.lit("none"))).drop("flat")


def rule_hits(acoustic: DataFrame, semantic: DataFrame, key: str = "span_id") -> DataFrame:
    """key, candidate, hit: the first acoustic candidate that semantics supports, else the first one."""
    s = semantic.filter("score > 0").select(key, "candidate").distinct().withColumn("held", F.lit(True))
    both = acoustic.join(s, [key, "candidate"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    return both.groupBy(key).agg(F.min_by("candidate", F.struct(~F.col("held"), F.col("rank"))).alias("candidate"), F.bool_or("held").alias("hit"))


def grounding(near: DataFrame, entity_wiki: DataFrame, k: int = 6, floor: float = 0.35, per_entity: int = 2, wiki_floor: float = 0.55) -> DataFrame:
    """query, pos, source, title, score: the nearest cards, then pages of the entities met, each title once."""
    mind = near.filter((F.col("rank") <= k) & (F.col("score") >= floor)).select("query", F.lit(0).alias("side"), "rank", F.lit(0).alias("page"), F.lit("mind").alias("source"), F.col("card").cast("string").alias("title"), "score")
    top = entity_wiki.filter(F.col("score") >= wiki_floor).withColumn("page", F.row_number().over(Window.partitionBy("query", "entity").orderBy(F.desc("score"), "title"))).filter(F.col("page") <= per_entity)
    wiki = top.select("query", F.lit(1).alias("side"), F.col("ord").alias("rank"), "page", F.lit("wiki").alias("source"), "title", "score")
    both = mind.unionByName(wiki).withColumn("n", F.row_number().over(Window.partitionBy("query", "side", "title").orderBy("rank", "page"))).filter("n = 1")
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("side", "rank", "page"))).select("query", "pos", "source", "title", "score")


def render_grounding(items: DataFrame, most: int = 12) -> DataFrame:
    """query, line: anchors as one line, pages marked as such."""
    word = F.when(F.col("source") == "wiki", F.concat(F.lit("維基:"), F.col("title"))).otherwise(F.col("title"))
    kept = items.filter(F.col("pos") <= most).withColumn("word", word)
    return kept.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), "、").alias("line"))


def render_evidence(rows: DataFrame, key: str = "span_id") -> DataFrame:
    """key, line: candidates with their evidence in brackets, by rank."""
    word = F.concat("candidate", F.lit("("), "evidence", F.lit(")"))
    return rows.withColumn("word", word).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("line"))
