"""Small edits of the notes carried through to what is derived from them.

An edit is a set of signed rows: what a note was, with -1, and what it is, with
+1.  Edges, degrees, counts and the acoustic seed follow by adding such rows up,
so the work and the rows written grow with the edit.  Each derived table notes
in its commits which version of the notes it reflects; after a crash it starts
from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.sources.tablelog import TableLog
from lexiforge.written import cut

NOTES = "term string, category string, is_special boolean, variants array<string>, links array<string>"


def raw_links(notes: DataFrame) -> DataFrame:
    """src, dst, weight of the links of signed notes."""
    return notes.select(F.col("term").alias("src"), F.explode(F.array_distinct("links")).alias("dst"), "weight")


def kind_of(dst: str = "dst") -> Column:
    return F.when(F.col(dst).startswith("domains/"), "domain").otherwise("rel")


class Views:
    """Edges (src, dst, kind), degrees (id, n), counts (category, n) and seed (term, variants) of a table of notes, one for each term."""

    def __init__(self, notes: TableLog, path: str):
        self.notes = notes
        table = lambda name, schema: TableLog(notes.spark, f"{path}/{name}", schema)
        self.edges, self.degrees = table("edges", "src string, dst string, kind string"), table("degrees", "id string, n long")
        self.counts, self.seed = table("counts", "category string, n long"), table("seed", "term string, variants array<string>")

    @staticmethod
    def _seen(view: TableLog) -> int:
        """The version of the notes that a table reflects, -1 before the first."""
        now = view.latest()
        return int(view.entry(now)["operation"].rsplit(" ", 1)[1]) if now >= 0 else -1

    def refresh(self) -> dict[str, int]:
        """Bring all tables to the newest version of the notes; how many rows of each differ."""
        now = self.notes.latest()
        return {name: self._refresh(name, now) for name in ("edges", "degrees", "counts", "seed") if self._seen(getattr(self, name)) < now}

    def _refresh(self, name: str, now: int) -> int:
        view = getattr(self, name)
        seen = self._seen(view)
        delta = cut(getattr(self, f"_{name}")(self.notes.changes(seen, now), seen, now))
        changed = delta.count()
        keys = {"edges": ["src", "dst"], "degrees": ["id"], "counts": ["category"], "seed": ["term"]}[name]
        if name in ("degrees", "counts"):
            held = view.read().join(delta.select(*keys), keys, "left_semi")
            rows = held.unionByName(delta.select(*keys, F.col("weight").alias("n"))).groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")
        else:
            rows = delta.filter("weight > 0").drop("weight")
        view.upsert(rows, keys, keys=delta.select(*keys), operation=f"notes {now}")
        return changed

    def _counts(self, notes: DataFrame, seen: int, now: int) -> DataFrame:
        return notes.filter("category <> ''").groupBy("category").agg(F.sum("weight").alias("weight")).filter("weight <> 0")

    def _degrees(self, notes: DataFrame, seen: int, now: int) -> DataFrame:
        return raw_links(notes).filter(kind_of() == "domain").groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("weight")).filter("weight <> 0")

    def _seed(self, notes: DataFrame, seen: int, now: int) -> DataFrame:
        return notes.filter("is_special").groupBy("term", "variants").agg(F.sum("weight").alias("weight")).filter("weight <> 0")

    def _edges(self, notes: DataFrame, seen: int, now: int) -> DataFrame:
        """Links that differ, as far as they lead to terms that are there now, and old links to terms that came or went."""
        notes = cut(notes)
        links = raw_links(notes).groupBy("src", "dst").agg(F.sum("weight").alias("weight")).filter("weight <> 0")
        there = self.notes.read(now).select(F.col("term").alias("dst"))
        domains = links.filter(kind_of() == "domain")
        related = links.filter(kind_of() == "rel").join(there, "dst", "left_semi").select("src", "dst", "weight")
        moved = cut(notes.groupBy(F.col("term").alias("dst")).agg(F.sum("weight").alias("by")).filter("by <> 0"))
        out = domains.unionByName(related)
        if seen >= 0 and not moved.isEmpty():
            old = raw_links(self.notes.read(seen).withColumn("weight", F.lit(1)))
            out = out.unionByName(old.join(F.broadcast(moved), "dst").select("src", "dst", F.col("by").alias("weight")))
        return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).filter("weight <> 0").withColumn("kind", kind_of())


def rebuilt(notes: DataFrame) -> dict[str, DataFrame]:
    """The four tables from all notes."""
    links = raw_links(notes.withColumn("weight", F.lit(1))).drop("weight").withColumn("kind", kind_of())
    terms = notes.select(F.col("term").alias("dst"))
    edges = links.filter("kind = 'domain'").unionByName(links.filter("kind = 'rel'").join(terms, "dst", "left_semi").select("src", "dst", "kind"))
    return {
        "edges": edges,
        "degrees": edges.filter("kind = 'domain'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")),
        "counts": notes.filter("category <> ''").groupBy("category").agg(F.count("*").alias("n")),
        "seed": notes.filter("is_special").select("term", "variants"),
    }
