"""Encyclopedia entries: canonical titles, aliases through redirects, incremental vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import title_text


def canonical_pages(pages: DataFrame, least: int = 2) -> DataFrame:
    """title, pageid of articles (ord, page_id, namespace, title, is_redirect): the first page of a title."""
    ok = pages.filter((F.col("namespace") == 0) & (F.col("is_redirect") == 0)).withColumn("name", title_text(F.col("title"))).filter(F.length("name") >= least)
    return ok.groupBy("name").agg(F.min_by("page_id", "ord").alias("pageid")).withColumnRenamed("name", "title")


def aliases(pages: DataFrame, redirects: DataFrame, canon: DataFrame, most: int = 12) -> DataFrame:
    """title, aliases: names that redirect to a canonical title, in order, at most ``most``.

    redirects: (ord, rd_from, namespace, title).
    """
    p = pages.filter("namespace = 0").select(F.col("page_id").alias("rd_from"), title_text(F.col("title")).alias("alias")).dropDuplicates(["rd_from"])
    r = redirects.filter("namespace = 0").withColumn("target", title_text(F.col("title"))).join(p, "rd_from").filter("alias <> '' and alias <> target")
    r = r.join(canon.select(F.col("title").alias("target")), "target", "left_semi").groupBy("target", "alias").agg(F.min("ord").alias("ord"))
    ranked = r.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("ord"))).filter(F.col("n") <= most)
    return ranked.groupBy(F.col("target").alias("title")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "alias"))), lambda x: x["alias"]).alias("aliases"))


def entries(pages: DataFrame, redirects: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """title, aliases, pageid."""
    canon = canonical_pages(pages, least)
    return canon.join(aliases(pages, redirects, canon, most), "title", "left").select("title", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "pageid")


def entry_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.size("aliases")), F.lit(0)).alias("aliases_total"))


def redirect_column(rows: DataFrame) -> int:
    """Where page rows (array of strings in ``fields``) hold the redirect flag: 3, or 4 in older dumps."""
    first = rows.filter((F.size("fields") > 4) & (F.col("fields")[1] == "0")).select(F.col("fields")[3].alias("f")).first()
    return 3 if first is None or first["f"] in ("0", "1") else 4


def to_index(rows: DataFrame, indexed: DataFrame) -> DataFrame:
    """Entries whose title has no vector yet."""
    return rows.join(indexed.select("title"), "title", "left_anti")


def write_entries(rows: DataFrame, path: str) -> dict[str, int]:
    """Entries as JSON lines, and how many there are, with their aliases."""
    rows.select("title", "aliases", "pageid").write.mode("overwrite").json(path)
    return entry_stats(rows.sparkSession.read.schema("title string, aliases array<string>, pageid long").json(path)).first().asDict()


def newest_dump(names: DataFrame, pattern: str) -> str | None:
    """The last of the files (path) whose name fits, by name; None if there is none."""
    return names.filter(F.regexp_extract("path", "[^/]*$", 0).rlike(pattern)).agg(F.max("path")).first()[0]
