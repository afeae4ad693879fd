"""Readers of text sources: transcripts, subtitles, term lists, seeds and markdown notes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import lines_of, safe_name, strip

SUBTITLE_NOISE = "^[0-9]+$|-->|^\\s*$"
TEXT_SUFFIXES = (".txt", ".srt")
ARCHIVE = "_excluded"


def subtitle_text(text: Column) -> Column:
    """Spoken lines of a subtitle file: numbers, times and blank lines dropped."""
    return F.array_join(F.filter(F.transform(lines_of(text), strip), lambda s: ~s.rlike(SUBTITLE_NOISE)), "\n")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of .txt and .srt files under a path, subtitles reduced to speech; others are refused."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    suffix = F.lower(F.regexp_extract("file", "(\\.[^./]*)$", 1))
    checked = F.when(suffix.isin(*TEXT_SUFFIXES), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("only .txt and .srt are read: "), F.col("file"))))
    return files.select("file", F.when(suffix == ".srt", subtitle_text(checked)).otherwise(checked).alias("text"))


def listed_sources(spark: SparkSession, path: str) -> DataFrame:
    """rel, hash, size, archived of all files under a path; hidden, private and package folders are skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.load(path)
    try:  # the reader itself passes over folders with a leading underscore
        files = files.unionByName(reader.load(f"{path.rstrip('/')}/{ARCHIVE}"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    root = path if "://" in path or path.startswith("file:") else f"file:{path}"
    rel = F.regexp_replace(F.col("path"), f"^{root.rstrip('/')}/?", "")
    parts = F.split(rel, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    archived = F.get(folders, F.lit(0)) == ARCHIVE
    ok = ~F.exists(folders, lambda d: d.startswith("_") | d.startswith(".") | (d == "package")) | archived
    return files.select(rel.alias("rel"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.coalesce(archived, F.lit(False)).alias("archived"), ok.alias("ok")).filter(F.col("ok") & ~F.col("rel").endswith(".gitkeep")).drop("ok")


def read_term_lists(spark: SparkSession, path: str) -> DataFrame:
    """term of plain lists (# for comments) and of JSON lists of strings or {term | correct}."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    plain = text.filter(~F.col("file").endswith(".json")).select(F.explode(lines_of(F.col("text"))).alias("t")).select(strip(F.col("t")).alias("term")).filter("term <> '' and term not like '#%'")
    found = F.try_parse_json("text")
    items = F.coalesce(F.try_variant_get(found, "$.terms", "array<variant>"), F.try_variant_get(found, "$", "array<variant>"))
    rows = text.filter(F.col("file").endswith(".json")).select(F.explode(items).alias("v"))
    value = F.coalesce(F.try_variant_get("v", "$.term", "string"), F.try_variant_get("v", "$.correct", "string"), F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")))
    return plain.union(rows.select(strip(value).alias("term")).filter("term <> ''"))


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """correct, variants of the special terms of an acoustic seed file."""
    schema = "terms array<struct<correct:string, variants:array<string>, is_special:boolean, tier:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("terms"))
    return rows.filter("is_special").select("correct", F.filter(F.transform("variants", strip), lambda v: v != "").alias("variants"))


def note_fields(text: Column) -> Column:
    """map of the frontmatter of a markdown note."""
    front = F.regexp_extract(text, "(?s)^---\\n(.*?)\\n---", 1)
    pairs = F.filter(F.split(front, "\n"), lambda s: s.contains(":"))
    return F.map_from_entries(F.transform(pairs, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)).alias("k"), F.trim(F.regexp_replace(s, "^[^:]*:", "")).alias("v"))))


def _listed(value: Column, braces: str) -> Column:
    inner = F.regexp_replace(F.coalesce(value, F.lit("")), f"^[{braces}]+|[{braces}]+$", "")
    return F.filter(F.transform(F.split(inner, ","), lambda v: F.trim(v)), lambda v: v != "")


def _mapped(value: Column) -> Column:
    pairs = F.filter(_listed(value, "{}"), lambda p: p.rlike(":\\s*\\S"))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("v"))))


def parse_notes(notes: DataFrame) -> DataFrame:
    """Notes (name, text) to term rows: frontmatter fields, gloss, context, relations and links."""
    f = F.col("f")
    get = lambda k: F.coalesce(F.try_element_at(f, F.lit(k)), F.lit(""))
    body = F.regexp_replace(F.col("text"), "(?s)^---\\n.*?\\n---", "")
    rel = "關係： \\[\\[([^\\]]+)\\]\\](?:（([^）]*)）)?"
    targets, descr = F.regexp_extract_all(body, F.lit(rel), F.lit(1)), F.regexp_extract_all(body, F.lit(rel), F.lit(2))
    plain = {k: get(k).alias(k) for k in ("term_lang", "ipa", "category", "source", "tier", "reason")}
    plain["ipa"] = F.coalesce(F.nullif(get("ipa"), F.lit("")), get("pinyin_key")).alias("ipa")  # older notes
    return notes.withColumn("f", note_fields(F.col("text"))).select(
        "name",
        F.coalesce(F.nullif(get("term"), F.lit("")), F.regexp_replace("name", "\\.md$", "")).alias("term"),
        *plain.values(),
        F.coalesce(get("confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
        (F.lower(get("is_special")) == "true").alias("is_special"),
        (F.lower(get("locked")) == "true").alias("locked"),
        _listed(get("variants"), "\\[\\]").alias("variants"),
        _mapped(get("names")).alias("names"),
        _mapped(get("names_src")).alias("names_src"),
        F.trim(F.regexp_extract(body, "(?m)^\\*(.+)\\*$", 1)).alias("gloss"),
        F.trim(F.regexp_extract(body, "(?m)^> (.+)$", 1)).alias("context"),
        F.transform(F.arrays_zip(targets.alias("target"), descr.alias("descr")), lambda r: F.struct(F.trim(r["target"]).alias("target"), F.trim(F.coalesce(r["descr"], F.lit(""))).alias("descr"))).alias("relations"),
        F.array_distinct(F.regexp_extract_all(body, F.lit("\\[\\[([^\\]|]+)\\]\\]"), F.lit(1))).alias("links"),
    )


def render_notes(terms: DataFrame) -> DataFrame:
    """name, text: a markdown note for each term (with names, variants, homophones, relations)."""
    pair = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    link = lambda x: F.concat(F.lit("[["), x, F.lit("]]"))
    line = lambda label, value: F.concat(F.lit(label), value)
    front = F.concat_ws(
        "\n",
        F.lit("---"),
        *[line(f"{c}: ", F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("term", "term_lang", "ipa", "category", "source", "tier", "confidence", "reason", "is_special", "locked")],
        F.concat(F.lit("names: {"), pair(F.col("names")), F.lit("}")),
        F.concat(F.lit("names_src: {"), pair(F.col("names_src")), F.lit("}")),
        F.concat(F.lit("variants: ["), F.array_join("variants", ", "), F.lit("]")),
        F.lit("---\n"),
    )
    some = lambda cond, text: F.when(cond, text)
    relations = F.transform("relations", lambda r: F.concat(F.lit("關係： "), link(r["target"]), F.when(r["descr"] != "", F.concat(F.lit("（"), r["descr"], F.lit("）"))).otherwise("")))
    body = F.concat_ws(
        "\n",
        line("# ", F.concat(F.col("term"), F.lit("\n"))),
        some(F.col("gloss") != "", F.concat(F.lit("*"), F.col("gloss"), F.lit("*\n"))),
        some(F.col("context") != "", F.concat(F.lit("> "), F.col("context"), F.lit("\n"))),
        some(F.size("variants") > 0, line("ASR 錯法： ", F.array_join(F.transform("variants", link), "、"))),
        some(F.size("homophones") > 0, line("同音： ", F.array_join(F.transform("homophones", link), "、"))),
        F.when(F.size("relations") > 0, F.array_join(relations, "\n")),
        F.concat(F.lit("領域： [[domains/"), safe_name(F.col("category")), F.lit("]]\n")),
    )
    return terms.select(F.concat(safe_name(F.col("term")), F.lit(".md")).alias("name"), F.concat_ws("\n", front, body).alias("text"))
