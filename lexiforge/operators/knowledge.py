"""Knowledge build: merging terms of several sources, tiers, relations, lists and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import UNCLASSIFIED, canon_category, flatten, merge_maps, ordered_distinct


def _first(value: str | Column, order: str | Column = "ord", when: Column | None = None) -> Column:
    """The first value by order that is neither null nor empty."""
    v = F.col(value) if isinstance(value, str) else value
    ok = when if when is not None else v.isNotNull() & (v != "")
    return F.min_by(F.when(ok, v), F.when(ok, F.col(order) if isinstance(order, str) else order))


def merge_fill_first(rows: DataFrame, key: str = "term", glyphs: dict[str, str] | None = None) -> DataFrame:
    """Document entities by folded term: occurrences summed, files gathered, each field from the first row that has it.

    Where the rows have ``variants`` each distinct one is kept in the order of its
    first row; where they have ``names`` (and ``names_src``) each language has its
    first name, ``gen`` where its source isn't told.  Lists are taken apart
    before they are grouped, so a frequent term gathers only what is distinct.
    """
    rows = rows.withColumn("flat", flatten(F.col(key), glyphs))
    out = rows.groupBy("flat").agg(
        F.min_by(key, "ord").alias("term"),
        F.sum("occ").alias("occ"),
        F.array_sort(F.collect_set("file")).alias("files"),
        _first("gloss").alias("gloss"),
        _first("category").alias("category"),
        _first("reason").alias("reason"),
        F.bool_or(F.coalesce("is_special", F.lit(False))).alias("is_special"),
    )
    if "variants" in rows.columns:
        one = rows.select("flat", "ord", F.posexplode("variants").alias("k", "v")).filter("v <> ''").groupBy("flat", "v").agg(F.min(F.struct("ord", "k")).alias("at"))
        found = one.groupBy("flat").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("variants"))
        out = out.join(found, "flat", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<string>")))
    if "names" in rows.columns:
        src = F.try_element_at(F.col("names_src"), F.col("iso")) if "names_src" in rows.columns else F.lit(None).cast("string")
        keep = ["names_src"] if "names_src" in rows.columns else []
        each = rows.select("flat", "ord", *keep, F.explode("names").alias("iso", "value")).select("flat", "ord", "iso", "value", F.coalesce(src, F.lit("gen")).alias("src"))
        none = F.create_map().cast("map<string,string>")
        out = out.join(merge_names(each, ["flat"]), "flat", "left").withColumns({c: F.coalesce(c, none) for c in ("names", "names_src")})
    return out


def merge_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, names, names_src from rows (keys, ord, iso, value, src): the first value of each language."""
    one = rows.filter("value <> ''").groupBy(*keys, "iso").agg(F.min_by(F.struct("value", "src"), "ord").alias("f"))
    pairs = F.array_sort(F.collect_list(F.struct("iso", "f.value", "f.src")))
    as_map = lambda field: F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["iso"], p[field])))
    return one.groupBy(*keys).agg(as_map("value").alias("names"), as_map("src").alias("names_src"))


def merge_most_confident(rows: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """Glossary rows (ord, term, confidence, category, variants, names) by folded term.

    In order, a row counts if its confidence is at least that of all before it;
    rows below are ignored with all they hold.  The last one that counts gives
    the fields; variants of all that count are joined, later names win.
    """
    r = rows.withColumn("flat", flatten(F.col("term"), glyphs))
    before = Window.partitionBy("flat").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    counted = r.withColumn("top", F.max("confidence").over(before)).filter(F.col("top").isNull() | (F.col("confidence") >= F.col("top")))
    last = F.max_by(F.struct("term", "confidence", "category"), "ord")
    all_rows = F.array_sort(F.collect_list(F.struct("ord", "variants", F.map_entries("names").alias("names"))))  # maps have no order
    variants = ordered_distinct(F.flatten(F.transform(all_rows, lambda x: F.coalesce(x["variants"], F.array().cast("array<string>")))), glyphs)
    names = F.aggregate(all_rows, F.create_map().cast("map<string,string>"), lambda acc, x: merge_maps(acc, F.coalesce(F.map_from_entries(x["names"]), F.create_map().cast("map<string,string>"))))
    out = counted.groupBy("flat").agg(last.alias("l"), variants.alias("variants"), names.alias("names"))
    return out.select("flat", "l.term", "l.confidence", "l.category", F.filter("variants", lambda v: flatten(v, glyphs) != F.col("flat")).alias("variants"), "names")


def enrich(gold: DataFrame, entities: DataFrame) -> DataFrame:
    """Gold terms with empty gloss and category filled from entities; entities never add terms."""
    e = entities.select("flat", F.col("gloss").alias("__gloss"), F.col("category").alias("__category"))
    joined = gold.join(e, "flat", "left")
    fill = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}"), F.lit(""))
    return joined.select(*[fill(c).alias(c) if c in ("gloss", "category") else F.col(c) for c in gold.columns])


def overlay_special(first: DataFrame, second: DataFrame) -> DataFrame:
    """flat, term, category, gloss, is_special, reason: the second pass marks, retypes and adds terms."""
    a, b = first.alias("a"), second.alias("b")
    return a.join(b, F.col("a.flat") == F.col("b.flat"), "full").select(
        F.coalesce("a.flat", "b.flat").alias("flat"),
        F.coalesce("a.term", "b.term").alias("term"),
        F.coalesce(F.nullif("b.category", F.lit("")), "a.category").alias("category"),
        F.coalesce(F.nullif("a.gloss", F.lit("")), "b.gloss").alias("gloss"),
        (F.coalesce("a.is_special", F.lit(False)) | F.col("b.flat").isNotNull()).alias("is_special"),
        F.coalesce(F.nullif("a.reason", F.lit("")), "b.reason").alias("reason"),
    )


def tiers(terms: DataFrame) -> DataFrame:
    """Terms with tier, confidence, is_special, reason and canonical category by source.

    Glossary terms are T1 with variants, T1g without, always special; extracted
    ones T2 if special, else T3.
    """
    gold = F.col("source").startswith("glossary")
    tier = F.when(gold, F.when(F.size("variants") > 0, "T1").otherwise("T1g")).otherwise(F.when(F.col("is_special"), "T2").otherwise("T3"))
    return terms.withColumns(
        {
            "tier": tier,
            "confidence": F.when(gold, F.col("confidence")).when(F.col("is_special"), 0.7).otherwise(0.5),
            "is_special": gold | F.col("is_special"),
            "reason": F.when(gold, F.coalesce(F.nullif("reason", F.lit("")), F.lit("A"))).otherwise(F.col("reason")),
            "category": canon_category(F.col("category")),
        }
    )


def relations(rows: DataFrame, terms: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """source, target, descr: the first relation between two different known terms."""
    t = terms.select(flatten(F.col("term"), glyphs).alias("flat"), "term").dropDuplicates(["flat"])
    r = rows.withColumn("s", flatten(F.col("source"), glyphs)).withColumn("t", flatten(F.col("target"), glyphs)).filter("s <> t")
    once = r.groupBy("s", "t").agg(F.min_by("descr", "ord").alias("descr"))
    a, b = t.select(F.col("flat").alias("s"), F.col("term").alias("source")), t.select(F.col("flat").alias("t"), F.col("term").alias("target"))
    return once.join(a, "s").join(b, "t").select("source", "target", "descr")


def homophones(terms: DataFrame) -> DataFrame:
    """term, others: different terms of the same sound."""
    groups = terms.filter("ipa <> ''").groupBy("ipa").agg(F.array_sort(F.collect_set("term")).alias("all")).filter(F.size("all") > 1)
    return groups.withColumn("term", F.explode("all")).select("term", F.array_except("all", F.array("term")).alias("others"))


def keep_locked(built: DataFrame, existing: DataFrame, fields: list[str], key: str = "term") -> DataFrame:
    """Built terms; where a locked one exists its fields win unless empty."""
    old = existing.filter("locked").select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__locked"))
    joined = built.join(old, key, "left")
    out = [F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")) if dict(built.dtypes)[c] == "string" else F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in built.columns]
    return joined.select(*out, F.coalesce("__locked", F.lit(False)).alias("locked"))


def category_counts(terms: DataFrame) -> DataFrame:
    """category, n, the most frequent first."""
    return terms.filter("category <> ''").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def known_terms(entities: DataFrame, most: int = 60) -> DataFrame:
    """term, occ of the ``most`` entities that occur most: what the second pass is told."""
    return entities.select("term", "occ").orderBy(F.desc("occ"), "term").limit(most)


def list_sizes(terms: DataFrame) -> DataFrame:
    """One row: terms, special ones, terms with variants, and variants in all."""
    n = F.coalesce(F.size("variants"), F.lit(0))
    return terms.agg(F.count("*").alias("terms"), F.count_if("is_special").alias("special"), F.count_if(n > 0).alias("with_variants"), F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).alias("variants"))


def rename_term(terms: DataFrame, relations: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(terms, relations) with a term renamed and locked; its old form becomes a variant."""
    here = F.col("term") == old
    given = F.array_remove(F.array_distinct(F.concat("variants", F.array(F.lit(old)))), new)
    renamed = terms.withColumns({"variants": F.when(here, given).otherwise(F.col("variants")), "locked": F.col("locked") | here, "term": F.when(here, F.lit(new)).otherwise(F.col("term"))})
    ends = {c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)) for c in ("source", "target")}
    return renamed, relations.withColumns(ends)


def vault_stats(terms: DataFrame) -> DataFrame:
    """by, value, n: totals by category, tier and kind of source, and all, in one pass of grouping sets."""
    t = terms.select("category", "tier", F.substring_index("source", ":", 1).alias("source"))
    sets = t.groupingSets([[F.col("category")], [F.col("tier")], [F.col("source")], []], F.col("category"), F.col("tier"), F.col("source"))
    g = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "tier").when(F.col("g") == 6, "source").otherwise("all").alias("by"), F.coalesce(F.when(F.col("g") == 3, F.col("category")).when(F.col("g") == 5, F.col("tier")).when(F.col("g") == 6, F.col("source")), F.lit("")).alias("value"), "n")


def special_list(terms: DataFrame, contains: str = "", special_only: bool = False) -> DataFrame:
    """term, n_variants of the high-trust list, most variants first."""
    kept = terms.filter(F.contains("term", F.lit(contains)))
    if special_only:
        kept = kept.filter("is_special")
    return kept.select("term", F.size("variants").alias("n_variants")).orderBy(F.desc("n_variants"), "term")


def members(terms: DataFrame) -> DataFrame:
    """category, terms: the sorted distinct terms of each category."""
    return terms.groupBy("category").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def seed_rows(terms: DataFrame) -> DataFrame:
    """correct, variants, is_special, tier: the acoustic seed rebuilt from the terms."""
    return terms.select(F.col("term").alias("correct"), F.filter(F.transform("variants", lambda v: F.trim(v)), lambda v: v != "").alias("variants"), "is_special", "tier")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` in place of rows of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def remove(old: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return old.join(gone.select(key), key, "left_anti")


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def set_variants(terms: DataFrame, edits: DataFrame) -> DataFrame:
    """Variants of edited terms overwritten, distinct and without the term itself; the term is locked."""
    e = edits.select("term", F.col("variants").alias("__v"))
    joined = terms.join(e, "term", "left")
    new = F.filter(ordered_distinct(F.col("__v")), lambda v: v != F.col("term"))
    return joined.select(*[F.when(F.col("__v").isNotNull(), new).otherwise(F.col("variants")).alias("variants") if c == "variants" else (F.col("locked") | F.col("__v").isNotNull()).alias("locked") if c == "locked" else F.col(c) for c in terms.columns])


def build_status(failed: Column, labels: Column) -> Column:
    """failed if every stage failed, partial if anything was noted, else complete."""
    return F.when(F.bool_and(failed), "failed").when(F.bool_or(failed | (F.size(labels) > 0)), "partial").otherwise("complete")


def special_notes(terms: DataFrame, domain: str, head: str = "{} terms", concepts: str = "Concepts with a fixed translation") -> DataFrame:
    """place, line: the list of special terms of a domain as a note.

    First its front matter and title, then the concepts (reason B), then each
    category by name; a section is one line of its distinct terms.
    """
    special = terms.filter("is_special").withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit(UNCLASSIFIED)))
    listed = lambda df: df.groupBy("section").agg(F.array_join(F.array_sort(F.collect_set("term")), "、").alias("terms"))
    first = listed(special.filter("reason = 'B'").withColumn("section", F.lit(concepts))).withColumn("rank", F.lit(1))
    rest = listed(special.withColumn("section", F.col("category"))).withColumn("rank", F.lit(2))
    n = special.agg(F.count("*").alias("n"))
    title = n.select(F.lit(0).alias("rank"), F.lit("").alias("section"), F.array(F.lit("---"), F.lit(f"domain: {domain}"), F.concat(F.lit("term_count: "), "n"), F.lit("---"), F.lit(""), F.lit("# " + head.format(domain)), F.lit("")).alias("lines"))
    body = first.unionByName(rest).select("rank", "section", F.array(F.concat(F.lit("## "), "section"), F.col("terms"), F.lit("")).alias("lines"))
    lines = title.unionByName(body).select("rank", "section", F.posexplode("lines").alias("k", "line"))
    return lines.select(F.struct("rank", "section", "k").alias("place"), "line")
