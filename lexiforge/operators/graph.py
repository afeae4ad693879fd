"""The term graph: vertices, typed edges and their figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_notes(notes: DataFrame, category: str = "", source: str = "", least: float = 0.0, contains: str = "", limit: int | None = 400) -> DataFrame:
    """Notes (name, term, category, source, confidence, links) to show: category and term by substring, source by prefix, first by name (``limit`` None: all)."""
    kept = notes.filter(F.contains("category", F.lit(category)) & F.col("source").startswith(source) & (F.col("confidence") >= least) & F.contains("term", F.lit(contains)))
    return kept if limit is None else kept.orderBy("name").limit(limit)


def graph_stats(notes: DataFrame, shown: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """One row: terms in all, whether shown or not, how many are shown, and the domains they lie in."""
    terms = notes.agg(F.count("*").alias("terms"))
    seen = shown.agg(F.count("*").alias("shown"))
    domains = edge_rows.filter("kind = 'domain'").agg(F.countDistinct("dst").alias("domains"))
    return terms.join(F.broadcast(seen), F.lit(True)).join(F.broadcast(domains), F.lit(True))


def edges(shown: DataFrame) -> DataFrame:
    """src, dst, kind: links to shown terms, and to domains."""
    links = shown.select(F.col("term").alias("src"), F.explode("links").alias("dst"))
    domain = links.filter(F.col("dst").startswith("domains/")).withColumn("kind", F.lit("domain"))
    rel = links.filter(~F.col("dst").startswith("domains/")).join(shown.select(F.col("term").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst").withColumn("kind", F.lit("rel"))
    return rel.unionByName(domain)


def vertices(shown: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """id, kind, category: the shown terms and the domains they lie in."""
    terms = shown.select(F.col("term").alias("id"), F.lit("term").alias("kind"), "category")
    domains = edge_rows.filter("kind = 'domain'").select(F.col("dst").alias("id"), F.lit("domain").alias("kind"), F.substring_index("dst", "/", -1).alias("category")).distinct()
    return terms.unionByName(domains)


def degrees(edge_rows: DataFrame, kind: str = "domain") -> DataFrame:
    return edge_rows.filter(F.col("kind") == kind).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))


def neighbours(edge_rows: DataFrame) -> DataFrame:
    """id, neighbour in both directions."""
    return edge_rows.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).union(edge_rows.select("dst", "src")).distinct()


def bipartite(cards: DataFrame, floor: float = 0.5, most: int = 120) -> tuple[DataFrame, DataFrame]:
    """(links (term, title, score), terms without a link), over the first ``most`` cards, 1 to 120."""
    few = cards.orderBy("term").limit(max(1, min(most, 120)))
    links = few.select("term", F.explode("wiki").alias("w")).filter(F.col("w.score") >= floor).select("term", F.col("w.title").alias("title"), F.col("w.score").alias("score"))
    return links, few.join(links, "term", "left_anti").select("term")


def reverse_links(links: DataFrame) -> DataFrame:
    """title, terms: which terms lead to a page."""
    return links.groupBy("title").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def best_links(links: DataFrame, most: int = 3) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "title"))
    return links.withColumn("rank", n).filter(F.col("rank") <= most)
