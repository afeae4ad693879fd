"""The stages in a row: from transcripts to spans, decisions, a dictionary and rules; from sources to terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import phonetic as P
from lexiforge.functions.text import bracket_first, canon_category, extract_anchor, local_sentence, split_sentences
from lexiforge.operators import candidates as C
from lexiforge.operators import chunks as K
from lexiforge.operators import decide as D
from lexiforge.operators import dictionary as Y
from lexiforge.operators import entities as N
from lexiforge.operators import evidence as E
from lexiforge.operators import knowledge as B

Enrich = Callable[[DataFrame], DataFrame]


def segment(batches: DataFrame, high: int = 400, low: int | None = None) -> DataFrame:
    """Segments of batches (batch_id, text)."""
    pieces = split_sentences(extract_anchor(F.col("text")))
    segs = K.segments(K.offset_chunks(K.atoms(batches, "batch_id", pieces), high, low))
    return segs.withColumn("seg_id", F.concat_ws("/", "batch_id", "seg_id"))


def detect(segs: DataFrame, targets: DataFrame, graded: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Spans: registered variants, then windows that sound like a target, then useful entities; one for each surface."""
    texts = segs.select(F.col("seg_id").alias("id"), F.col("core_text").alias("text"))
    hits = C.variant_scan(texts, graded.filter("not ambiguous").select("variant", "correct")).withColumn("detector", F.lit(0)).withColumn("via", F.lit("variant"))
    hits = hits.unionByName(C.window_scan(texts, targets).withColumn("detector", F.lit(1)).withColumn("via", F.lit("scan")))
    hits = hits.withColumnRenamed("id", "seg_id").withColumn("ord", F.struct("start", "correct"))
    if entities is not None:
        own = C.without_targets(N.useful_entities(entities), targets)
        hits = hits.unionByName(own.select("seg_id", "start", "surface", F.lit(None).cast("string").alias("correct"), F.lit(2).alias("detector"), F.lit("entity").alias("via"), F.struct("start", F.lit(None).cast("string").alias("correct")).alias("ord")))
    spans = C.fuse_detectors(hits).drop("ord").join(segs.select("seg_id", "core_text"), "seg_id")
    return spans.withColumn("context", bracket_first(F.col("core_text"), F.col("surface"))).withColumn("sentence", local_sentence(F.col("core_text"), F.col("surface")))


def weigh(spans: DataFrame, targets: DataFrame, graded: DataFrame, common: DataFrame, anchors: DataFrame | None = None, costs: P.Costs = P.DEFAULT) -> DataFrame:
    """Spans with candidate, rule_hit, common, review, decision and history.

    ``anchors`` (query = span_id, flat, score, source) come from vectors of the
    sentences; without them no candidate is supported.
    """
    surfaces = spans.select("surface").distinct()
    acoustic = C.acoustic_evidence(surfaces, graded, C.phonetic_join(surfaces, targets, costs), costs)
    per_span = spans.select("span_id", "surface").join(acoustic, "surface")
    asked = per_span.select(F.col("span_id").alias("query"), "candidate")
    held = E.semantic_evidence(asked, anchors) if anchors is not None else asked.withColumn("score", F.lit(0.0))
    rule = E.rule_hits(per_span, held.withColumnRenamed("query", "span_id"))
    known = common.select(F.col("word").alias("surface")).distinct().withColumn("common", F.lit(True))
    item = F.struct(F.lit(1).alias("iter"), F.col("surface").alias("value"), F.lit("model").alias("by"))
    out = spans.join(rule, "span_id", "left").join(known, "surface", "left")
    return out.select(
        "span_id", "seg_id", "surface", "start", "via", "context", "sentence", "candidate", F.coalesce("hit", F.lit(False)).alias("rule_hit"), F.coalesce("common", F.lit(False)).alias("common"),
        F.lit(D.DOUBTFUL).alias("review"), F.lit("pending").alias("decision"), F.lit(None).cast("string").alias("correct"), F.array(item).alias("history"),
    )


def rule_answers(spans: DataFrame) -> DataFrame:
    """The judge without a model: a rule hit stands."""
    return spans.withColumns({"parsed": F.lit(True), "abandon": ~F.col("rule_hit"), "xling": F.lit(False)})


def learn(judged: DataFrame, batches: DataFrame, common: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, dictionary, rules) after the judged spans are committed to the old occurrences."""
    rows = judged.select(F.substring_index("seg_id", "/", 1).alias("batch_id"), "correct", F.col("history")[0]["value"].alias("wrong"), "context", "decision").join(batches.select("batch_id", "domain"), "batch_id")
    occ = Y.occurrences(rows)
    occ = Y.merge_occurrences(old, occ) if old is not None else occ
    terms = Y.commit(occ, common)
    return occ, terms, Y.export_rules(terms, common)


def build_terms(entities: DataFrame, glossary: DataFrame, relations: DataFrame, existing: DataFrame | None = None, tune: Enrich | None = None) -> tuple[DataFrame, DataFrame]:
    """(terms, relations) of document entities and glossary rows.

    Glossary terms take only what they lack from documents; ``tune`` may
    re-judge categories; locked existing terms keep theirs.
    """
    gold = glossary.select("flat", "term", F.lit("glossary").alias("source"), "variants", F.lit(True).alias("is_special"), F.lit("").alias("reason"), "category", "confidence", F.lit("").alias("gloss"))
    docs = B.merge_fill_first(entities)
    found = docs.join(gold.select("flat"), "flat", "left_anti").select("flat", "term", F.lit("llm").alias("source"), F.array().cast("array<string>").alias("variants"), "is_special", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("category", F.lit("")).alias("category"), F.lit(0.0).alias("confidence"), F.coalesce("gloss", F.lit("")).alias("gloss"))
    terms = B.tiers(B.enrich(gold, docs.select("flat", "gloss", "category")).unionByName(found))
    terms = tune(terms) if tune else terms
    if existing is not None:
        terms = B.keep_locked(terms, existing, ["category", "gloss"])
    return terms, B.relations(relations, terms)


def relabel(terms: DataFrame) -> DataFrame:
    """Categories of all terms made canonical, nothing extracted anew."""
    return terms.withColumn("category", canon_category(F.col("category")))
