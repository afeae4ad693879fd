"""Extraction from sources: which file is read how, guards on model answers, harvests and their union.

Answers come from an injected model as rows (file, attempt, raw, finish); everything
here is what happens to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import CLEAN_EXTENSIONS, DIRTY_NAME, NUMERIC_TYPES, flatten, is_term, json_parses, name_sources, parse_names, strip
from lexiforge.operators.newwords import best_confidence
from lexiforge.sources.office import explode_objects

TEXT_EXTENSIONS = (".docx", ".pptx", ".pdf", ".srt", ".txt")
REASONS = ("A", "B", "C")
_FIELDS = "term string, name string, type string, domain string, gloss string, meaning string, desc string, reason string, names map<string,string>, variants array<string>, source string, target string"


def extension(rel: Column) -> Column:
    return F.lower(F.regexp_extract(rel, r"(\.[^./]+)$", 1))


def file_kind(rel: Column, forced: Column, with_model: bool = True) -> Column:
    """glossary, doc or skip: how a source file is read.

    Transcripts are left out by their name and by their extension unless forced;
    without a model only spreadsheets give anything.
    """
    name, ext = F.substring_index(rel, "/", -1), extension(rel)
    force = F.coalesce(forced, F.lit(False))
    doc = ext.isin(*TEXT_EXTENSIONS) & (ext.isin(*CLEAN_EXTENSIONS) | force) & F.lit(with_model)
    return F.when(name.rlike(DIRTY_NAME) & ~force, "skip").when(ext == ".xlsx", "glossary").when(doc, "doc").otherwise("skip")


def _objects(answers: DataFrame, texts: DataFrame) -> DataFrame:
    """file, attempt, pos, o (fields of the object), text for every object in answers that ended by themselves."""
    whole = answers.filter(F.coalesce("finish", F.lit("")) != "length").select(F.struct("file", "attempt").alias("id"), "raw")
    found = explode_objects(whole.select(F.to_json("id").alias("id"), "raw"), "id", "raw")
    rows = found.select(F.from_json("id", "file string, attempt int").alias("k"), "pos", F.from_json("object", _FIELDS).alias("o"))
    return rows.select("k.file", "k.attempt", "pos", "o").join(texts.select("file", "text"), "file")


def _usable(term: Column, text: Column) -> Column:
    return (term != "") & ~term.rlike("^[0-9]+$") & is_term(term) & F.contains(text, term)


def _text(*fields: str) -> Column:
    """The first of an object's fields that isn't empty."""
    return strip(F.coalesce(*[F.nullif(F.col(f"o.{f}"), F.lit("")) for f in fields], F.lit("")))


def first_pass(answers: DataFrame, texts: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """file, flat, term, category, gloss, names, names_src of the terms that the answers name and the text holds."""
    rows = _objects(answers, texts).withColumn("term", _text("term", "name"))
    rows = rows.filter(_usable(F.col("term"), F.col("text"))).withColumn("flat", flatten(F.col("term"), glyphs))
    names = parse_names(F.coalesce("o.names", F.create_map().cast("map<string,string>")))
    kept = F.struct("term", F.substring(_text("type", "domain"), 1, 12).alias("category"), F.substring(_text("gloss", "meaning", "desc"), 1, 60).alias("gloss"), names.alias("names"), "text")
    one = rows.groupBy("file", "flat").agg(F.min_by(kept, F.struct("attempt", "pos")).alias("f"))
    return one.select("file", "flat", "f.term", "f.category", "f.gloss", "f.names", name_sources(F.col("f.names"), F.col("f.text")).alias("names_src"))


def stated_relations(answers: DataFrame, texts: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """file, ord, source, target, descr: relations between two different words, from objects that name no term."""
    rows = _objects(answers, texts).filter(_text("term", "name") == "").withColumn("s", _text("source")).withColumn("t", _text("target"))
    kept = rows.filter((F.col("s") != "") & (F.col("t") != "") & (flatten(F.col("s"), glyphs) != flatten(F.col("t"), glyphs)))
    return kept.select("file", F.struct("attempt", "pos").alias("ord"), F.col("s").alias("source"), F.col("t").alias("target"), F.substring(_text("desc"), 1, 50).alias("descr"))


def second_pass(answers: DataFrame, texts: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """file, flat, term, category, reason, variants of terms with one of the ``REASONS``; the last mention counts."""
    rows = _objects(answers, texts).withColumn("term", _text("term")).withColumn("reason", F.substring(F.upper(_text("reason")), 1, 1))
    rows = rows.filter(_usable(F.col("term"), F.col("text")) & F.col("reason").isin(*REASONS)).withColumn("flat", flatten(F.col("term"), glyphs))
    said = F.transform(F.coalesce("o.variants", F.array().cast("array<string>")), strip)
    variants = F.filter(said, lambda v: (v != "") & is_term(v) & ~v.rlike("^[0-9]+$") & (flatten(v, glyphs) != F.col("flat")))
    kept = F.struct("term", F.substring(_text("type", "domain"), 1, 12).alias("category"), "reason", variants.alias("variants"))
    return rows.groupBy("file", "flat").agg(F.max_by(kept, F.struct("attempt", "pos")).alias("f")).select("file", "flat", "f.*")


def pass_status(answers: DataFrame) -> DataFrame:
    """file, status, labels: failed if the first attempt failed, partial if a later one did.

    An attempt fails that has no answer, is cut at the length limit or can't be parsed.
    """
    bad = F.when(F.col("raw").isNull(), "no_answer").when(F.col("finish") == "length", "length").when(~json_parses(F.col("raw")) & ~F.col("raw").rlike(r"(?s)\{.*\}"), "parse_failed")
    rows = answers.withColumn("label", bad)
    status = F.when(F.min_by("label", "attempt").isNotNull(), "failed").when(F.count("label") > 0, "partial").otherwise("complete")
    return rows.groupBy("file").agg(status.alias("status"), F.array_sort(F.collect_set("label")).alias("labels"))


def without_heard(entities: DataFrame, glossary: DataFrame, stop: tuple[str, ...] = (), glyphs: dict[str, str] | None = None) -> DataFrame:
    """Entities that are no mis-heard variant of the glossary and none of the words of its layout."""
    heard = glossary.select(F.explode("variants").alias("v")).select(flatten(F.col("v"), glyphs).alias("flat")).distinct()
    return entities.filter(~F.col("term").isin(*stop)).join(heard, "flat", "left_anti") if stop else entities.join(heard, "flat", "left_anti")


def harvest_entities(entities: DataFrame, stop: tuple[str, ...] = (), confidence: float = 0.8) -> DataFrame:
    """ord, term, source, confidence of recognised entities (ord, surface, type): two characters or more, no numbers or times."""
    word = strip(F.coalesce("surface", F.lit("")))
    kept = entities.withColumn("term", word).filter((F.length("term") >= 2) & ~F.col("type").isin(*NUMERIC_TYPES) & ~F.col("term").isin(*stop, ""))
    return kept.groupBy("term").agg(F.min("ord").alias("ord")).select("ord", "term", F.lit("ner").alias("source"), F.lit(confidence).alias("confidence"))


def harvest_listed(answers: DataFrame, texts: DataFrame, confidence: float = 0.85) -> DataFrame:
    """ord, term, source, confidence of the words in an answer's JSON list that the text holds."""
    raw = F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)(\[.*\])", 1)
    words = answers.select("file", F.posexplode(F.from_json(raw, "array<string>")).alias("ord", "w")).withColumn("term", strip(F.col("w")))
    kept = words.join(texts.select("file", "text"), "file").filter((F.length("term") >= 2) & F.contains("text", F.col("term")))
    return kept.groupBy("term").agg(F.min("ord").alias("ord")).select("ord", "term", F.lit("llm").alias("source"), F.lit(confidence).alias("confidence"))


def harvest(*bags: DataFrame) -> DataFrame:
    """term, source, confidence of all bags (ord, term, source, confidence), the most confident of each term, best first."""
    rows = None
    for place, bag in enumerate(bags):
        one = bag.select("term", "source", "confidence", F.struct(F.lit(place).alias("bag"), F.col("ord").cast("long").alias("ord")).alias("ord"))
        rows = one if rows is None else rows.unionByName(one)
    return best_confidence(rows).orderBy(F.desc("confidence"), "term")


def glossary_block(rows: DataFrame, most_context: int = 40) -> DataFrame:
    """file, block: glossary rows (file, ord, term, category, variants, context) written out for a model, one a line."""
    parts = F.concat_ws("；", "term", F.nullif("category", F.lit("")), F.nullif(F.array_join("variants", "、"), F.lit("")), F.nullif(F.substring("context", 1, most_context), F.lit("")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return rows.withColumn("line", parts).groupBy("file").agg(lines.alias("block"))


def taxonomy_block(kinds: dict[str, str], examples: dict[str, str], unknown: str) -> str:
    """What a model is told of the categories: their definitions, what to answer in doubt, and examples."""
    defined = "；".join(f"{k}（{v}）" for k, v in kinds.items())
    shown = "；".join(f"{w}＝{k}" for w, k in examples.items())
    return f"Categories, one for each entity: {defined}.\nIn doubt: “{unknown}”.\nExamples: {shown}.\n"


def extraction_questions(chunks: DataFrame, taxonomy: str, known: str = "", glossary: str = "") -> DataFrame:
    """``chunks`` (text, ...) with ``question``: what the first pass asks of a chunk, with categories, known terms and glossary where given."""
    before = taxonomy + (f"Known terms: {known}\n" if known else "") + (f"Glossary:\n{glossary}\n" if glossary else "")
    shape = '{"entities": [{"term": "", "type": "", "gloss": "", "names": {}}], "relationships": [{"source": "", "target": "", "desc": ""}]}'
    return chunks.withColumn("question", F.concat(F.lit(before), F.lit("Text:\n"), F.coalesce("text", F.lit("")), F.lit(f"\n\nOnly JSON: {shape}")))
