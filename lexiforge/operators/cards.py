"""Cards of the knowledge index: lookup by word, the pages stored with them, and what waits for work."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.readings import Reader
from lexiforge.functions.text import card_hash, card_text, flatten
from lexiforge.operators.vector_index import VectorIndex
from lexiforge.sources.tablelog import TableLog
from lexiforge.written import cut


def cards_of(words: DataFrame, cards: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """``words`` (word, ...) with ``card``: the first card (by ``ord``) whose term folds to the same form; null without one."""
    kept = F.struct(*[c for c in cards.columns if c != "ord"])
    first = cards.groupBy(flatten(F.col("term"), glyphs).alias("card_flat")).agg(F.min_by(kept, "ord").alias("card"))
    return words.join(first, flatten(F.col("word"), glyphs) == F.col("card_flat"), "left").drop("card_flat")


def stored_pages(mentions: DataFrame, cards: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """query, ord, entity, title, aliases, score: pages stored with the cards of the entities (query, ord, entity) met."""
    found = cards_of(mentions.withColumnRenamed("entity", "word"), cards, glyphs)
    pages = found.select("query", "ord", F.col("word").alias("entity"), F.explode("card.wiki").alias("w"))
    return pages.select("query", "ord", "entity", F.trim("w.title").alias("title"), "w.aliases", "w.score").filter("title <> ''")


def to_link(cards: DataFrame) -> DataFrame:
    """Cards with a vector and no pages yet."""
    return cards.filter(F.col("vec").isNotNull() & (F.coalesce(F.size("wiki"), F.lit(0)) <= 0))


def index_stats(targets: DataFrame, graded: DataFrame, cards: DataFrame) -> DataFrame:
    """One row: targets, those of the fuzzy layer, variants, ambiguous ones, cards and cards with a vector."""
    t = targets.agg(F.count("*").alias("targets"), F.count_if("is_cag").alias("fuzzy_targets"))
    g = graded.agg(F.count_if(~F.col("ambiguous")).alias("variants"), F.count_if("ambiguous").alias("ambiguous"))
    c = cards.agg(F.count("*").alias("cards"), F.count("vec").alias("embedded"))
    return t.join(g, F.lit(True)).join(c, F.lit(True))  # one row each


def notes_of(terms: DataFrame, words: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """word, term: the note that a word leads to: its own, else the one that lists it as a variant."""
    own = terms.select(flatten(F.col("term"), glyphs).alias("flat"), "term", F.lit(0).alias("way"))
    listed = terms.select(F.explode("variants").alias("v"), "term").select(flatten(F.col("v"), glyphs).alias("flat"), "term", F.lit(1).alias("way"))
    first = own.unionByName(listed).groupBy("flat").agg(F.min_by("term", F.struct("way", "term")).alias("term"))
    return words.select("word").join(first, flatten(F.col("word"), glyphs) == F.col("flat")).select("word", "term")


CARDS = "term string, gloss string, category string, variants array<string>, names map<string,string>, is_special boolean, tier string, source string, hash string, vec array<float>, wiki array<struct<title:string,aliases:array<string>,score:double>>"


def term_nodes(vertices: DataFrame, most: int = 100_000) -> DataFrame:
    """The vertices that are terms, the first ``most`` by name."""
    return vertices.filter("kind = 'term'").orderBy("id").limit(most)


def build_cards(nodes: DataFrame, cards: TableLog, embed: Callable[[DataFrame], DataFrame] | None, pages: VectorIndex | None = None, titles: DataFrame | None = None, k: int = 8, floor: float = 0.5) -> dict[str, int]:
    """Bring the table of cards (``CARDS``) up to the nodes (its columns up to ``source``); how many were embedded and linked.

    A card whose content has the same hash keeps its vector and its pages.
    ``embed`` turns (term, text) into (term, vec); without it, or where it has no
    vector, a card waits without one.  Cards with a vector and no pages are
    linked to the ``k`` nearest entries of the index ``pages`` from ``floor`` on, whose ``titles``
    are (id, title, aliases).  Cards of nodes that are gone go.  A commit by another
    builder in between is a ``Conflict``.
    """
    seen = cards.latest()
    fields = [f.name for f in cards.schema.fields][:8]
    text = [F.col("term"), F.col("gloss"), F.array_join(F.col("variants"), "、")]
    now = cut(nodes.select(*fields).dropDuplicates(["term"]).withColumn("hash", card_hash(*text)).withColumn("text", card_text(*text)))
    have = cards.read().filter("vec is not null").select("term", "hash", "vec", "wiki")
    kept = cut(now.join(have, ["term", "hash"]).drop("text"))
    fresh = now.join(have, ["term", "hash"], "left_anti")
    vectors = embed(fresh.select("term", "text")) if embed else None
    fresh = fresh.join(vectors.select("term", F.col("vec").cast("array<float>").alias("vec")), "term", "left") if vectors is not None else fresh.withColumn("vec", F.lit(None).cast("array<float>"))
    fresh = cut(fresh.drop("text"))
    waiting = F.col("vec").isNotNull() & (F.coalesce(F.size("wiki"), F.lit(0)) <= 0)
    rows = cut(kept.unionByName(fresh.withColumn("wiki", F.lit(None).cast(cards.schema["wiki"].dataType))))
    linked = 0
    if pages is not None and titles is not None:
        ask = cut(rows.filter(waiting).select(F.col("term").alias("id"), "vec"))
        near = pages.search(ask, k, floor=floor).join(titles.select(F.col("id").alias("card"), "title", "aliases"), "card")
        found = near.groupBy(F.col("query").alias("term")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "aliases", "score"))), lambda x: F.struct(x["title"].alias("title"), x["aliases"].alias("aliases"), x["score"].alias("score"))).alias("found"))
        linked = ask.count()
        rows = rows.join(found, "term", "left").withColumn("wiki", F.coalesce("wiki", "found", F.array().cast(cards.schema["wiki"].dataType))).drop("found")
    cards.replace(rows, seen)
    return {"terms": rows.count(), "embedded": fresh.filter("vec is not null").count(), "linked": linked}


def resync(build: Callable[[], dict[str, int]], alive: Callable[[], bool]) -> Future:
    """``build`` in the background, for after an edit; None where the embedder isn't there or the build fails, so that an edit never waits."""

    def run() -> dict[str, int] | None:
        try:
            return build() if alive() else None
        except Exception:
            return None

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(run)
    finally:
        pool.shutdown(wait=False)


def phonetic_index(targets: DataFrame, reader: Reader) -> DataFrame:
    """correct, ipa, is_cag, threshold, count: the targets as the phonetic layer sees them, to be kept as a table."""
    threshold = F.when(F.col("is_cag"), reader.costs.fuzzy).otherwise(reader.costs.exact)
    rows = targets.select("correct", reader.ipa(F.col("correct")).alias("ipa"), "is_cag", threshold.alias("threshold"))
    return rows.join(F.broadcast(targets.agg(F.count("*").alias("count"))), F.lit(True))  # one row
