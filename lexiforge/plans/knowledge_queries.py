"""Queries over the knowledge side: merging, tiers, relations, graph, new words, increments and sources."""

from __future__ import annotations

import zipfile
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.operators import graph as G
from lexiforge.operators import knowledge as K
from lexiforge.operators import newwords as W
from lexiforge.operators import wiki as I
from lexiforge.sources import office, readers
from lexiforge.streaming import incremental as S

from .registry import ITEMS, Fixture, query, table

NOTES = Fixture(
    "name string, term string, category string, source string, confidence double, links array<string>",
    [("a.md", "alpha", "技術", "glossary:x", 0.9, ["beta", "domains/技術", "none"]), ("b.md", "beta", "技術", "llm:y", 0.7, ["alpha", "domains/技術"]), ("c.md", "gamma", "人名", "llm:z", 0.5, ["alpha", "domains/人名", "delta"]), ("d.md", "delta", "", "newword", 0.3, [])],
    "SELECT 's' || s_suppkey || '.md', 's' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'n' || s_nationkey END, CASE WHEN s_suppkey % 2 = 0 THEN 'llm:y' ELSE 'glossary:x' END, 0.5, {list}('s' || s_suppkey * 3 % 110, 'domains/n' || s_nationkey, 'none') FROM supplier",
)
GLOSSARY = Fixture(
    "ord int, term string, confidence double, category string, variants array<string>, en string",
    [(1, "龍山寺", 0.8, "地點", ["龍山是"], "Longshan"), (2, "龍山寺", 0.7, "組織", ["隆山寺"], "Ignored"), (3, "龍山寺", 0.8, "", ["隆山司", "龍山是"], "Lungshan"), (4, "宏碁", 0.5, "公司", ["紅雞"], ""), (5, "宏碁", 0.9, "組織", [], "Acer"), (6, "宏碁", 0.6, "x", ["y"], "No")],
    "SELECT p_partkey + 100, p_brand || p_size, CAST(p_partkey * 7 % 10 AS DOUBLE) / 10, CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE '' END, {list}(p_name, 'v' || p_partkey % 5), CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END FROM part",
)
RELATIONS = Fixture("ord int, source string, target string, descr string", [(1, "alpha", "beta", "first"), (2, "alpha", "beta", "second"), (3, "beta", "alpha", "back"), (4, "alpha", "alpha", "self"), (5, "alpha", "omega", "unknown")], f"SELECT o * 10 + n + 100, 's' || s, 's' || p % 120, f || d FROM {ITEMS}")
NOTE_TEXT = Fixture(
    "name string, text string",
    [("龍山寺.md", "---\nterm: 龍山寺\ncategory: 地點地名\nsource: glossary:t\nconfidence: 0.9\nis_special: true\nlocked: false\nnames: {eng: Longshan Temple, jpn: 龍山寺}\nvariants: [龍山是, 隆山寺]\n---\n\n# 龍山寺\n\n*台北的寺廟*\n\n> 在龍山寺參拜\n\n關係： [[台北]]（位於）\n關係： [[觀音]]\n領域： [[domains/地點地名]]\n"), ("空.md", "no front matter\n[[x]]\n")],
    """SELECT 'n' || p_partkey || '.md', '---' || chr(10) || 'term: ' || p_name || ' ' || p_partkey || chr(10) || 'category: ' || p_type || chr(10) || 'confidence: 0.' || p_size % 10 || chr(10) || 'variants: [' || p_brand || ', v' || p_size || ']' || chr(10) || '---' || chr(10) || chr(10)
    || '*' || p_type || ' of ' || p_brand || '*' || chr(10) || CASE WHEN p_partkey % 3 > 0 THEN '關係： [[' || p_name || ']]（x）' ELSE '' END || chr(10) FROM part""",
)
DUMP = Fixture("line int, value string", [(1, "INSERT INTO `page` VALUES (1,'a(b','x'),(2,'it\\'s',NULL);"), (2, "INSERT INTO `t` VALUES (3,''),(4,'it''s', 0.5),(5,NULL,''),(6,'a\\\\b),(c');"), (3, "-- comment")], """SELECT p_partkey + 100, 'INSERT INTO `page` VALUES (' || p_partkey || ',' || chr(39) || p_name || '(x' || chr(39) || ',NULL),(' || p_size || ',' || chr(39) || chr(39) || ',' || chr(39) || p_type || chr(39) || chr(39) || 's' || chr(39) || ');' FROM part""")
OBJECTS = Fixture("id int, text string", [(1, 'x {"terms": [{"term": "a"}, {"term": "b", "names": {"eng": "B"}}], "relationships": [{"source": "a"}]} y'), (2, '{"term": "c"} {bad} {"n": {"m": 1}}'), (3, None)], """SELECT p_partkey + 100, 'x {"terms": [{"term": "' || p_name || '"}, {"term": "' || p_brand || '"}], "relationships": [{"source": "' || p_type || '"}]} {bad} {"n": ' || p_size || '}' FROM part""")
TERMS_OF_PART = "(SELECT DISTINCT p_name AS term, min(p_type) AS category, min(p_brand) AS brand FROM part GROUP BY p_name)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.when(F.col("page_id") % 4 == 0, ".srt").otherwise(".docx")).alias("rel"), F.sha2("html", 256).alias("hash"), (F.col("page_id") % 11 == 0).alias("archived"), "page_id")


FILES = "(SELECT regexp_replace(url, '^[a-z]+://', '') || CASE WHEN page_id % 4 = 0 THEN '.srt' ELSE '.docx' END AS rel, sha256(html) AS hash, page_id % 11 = 0 AS archived, page_id FROM pages)"
MANIFEST = f"(SELECT rel, CASE WHEN page_id % 5 = 1 THEN 'other' ELSE hash END AS hash, CASE page_id % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'complete' END AS build_status FROM {FILES} WHERE page_id % 3 <> 0)"


def _manifest(files: DataFrame) -> DataFrame:
    kept = files.filter("page_id % 3 <> 0")
    return kept.select("rel", F.when(F.col("page_id") % 5 == 1, "other").otherwise(F.col("hash")).alias("hash"), F.when(F.col("page_id") % 6 == 0, "failed").when(F.col("page_id") % 6 == 1, "partial").otherwise("complete").alias("build_status"))


STATUS = f"""(SELECT rel, CASE WHEN archived OR rel LIKE '%.srt' OR regexp_matches(rel, 'transcript|L3') THEN 'skip' WHEN m.hash = f.hash AND m.build_status IN ('partial', 'failed') THEN m.build_status WHEN m.hash = f.hash THEN 'extracted' WHEN m.hash IS NOT NULL THEN 'changed' ELSE 'new' END AS status FROM {FILES} f LEFT JOIN {MANIFEST} m USING (rel))"""


@query(f"SELECT rel, status FROM {STATUS}")
def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return S.source_status(f, _manifest(f)).select("rel", "status")


@query(f"SELECT status, count(*) AS n FROM {STATUS} GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return S.source_status(f, _manifest(f)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT rel FROM {FILES} f WHERE NOT EXISTS (SELECT 1 FROM {MANIFEST} m WHERE m.rel = f.rel AND m.hash = f.hash AND m.build_status = 'complete')")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    return S.to_extract(f, _manifest(f)).select("rel")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def incremental_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cards: a third has no vector yet, a fifth has changed."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("term"), F.sha2("text", 256).alias("hash"), "doc_id")
    cards = d.filter("doc_id % 3 <> 0").select("term", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.array(F.lit(1.0)).alias("vec"))
    return S.reuse_cards(d, cards)[1].select("doc_id")


@query("SELECT p_type AS term, arg_min('b' || p_size, (-p_retailprice, p_partkey)) AS source, max(p_retailprice) AS confidence FROM part GROUP BY p_type")
def best_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return W.best_confidence(p.select(F.col("p_type").alias("term"), F.concat(F.lit("b"), F.col("p_size").cast("string")).alias("source"), F.col("p_retailprice").alias("confidence"), F.col("p_partkey").alias("ord")))


@query(
    """SELECT o_custkey::varchar AS flat, count(*) AS occ, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS gloss, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 = 0) AS category, bool_or(o_totalprice > 200000) AS is_special, count(DISTINCT o_orderstatus) AS n_files FROM orders GROUP BY o_custkey"""
)
def merge_fill_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("term"), F.col("o_orderkey").alias("ord"), F.lit(1).alias("occ"), F.col("o_orderstatus").alias("file"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).otherwise("").alias("gloss"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("category"), F.lit("").alias("reason"), (F.col("o_totalprice") > 200000).alias("is_special"),
    )
    return K.merge_fill_first(rows).select("flat", F.col("occ").cast("long").alias("occ"), "gloss", "category", "is_special", F.size("files").cast("long").alias("n_files"))


@query(
    f"""WITH r AS (SELECT *, max(confidence) OVER (PARTITION BY term ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {GLOSSARY.sql}), c AS (SELECT * FROM r WHERE top IS NULL OR confidence >= top),
    v AS (SELECT term, x, min((ord, k)) AS o FROM (SELECT term, ord, unnest(variants) AS x, unnest(range(len(variants))) AS k FROM c) GROUP BY term, x)
    SELECT term, arg_max(confidence, ord) AS confidence, arg_max(category, ord) AS category, arg_max(en, ord) AS en, (SELECT string_agg(x, ',' ORDER BY o) FROM v WHERE v.term = c.term) AS variants FROM c GROUP BY term"""
)
def merge_max_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GLOSSARY.df(spark, sf_dir).withColumn("names", F.create_map(F.lit("eng"), F.col("en")))
    return K.merge_most_confident(g).select("term", "confidence", "category", F.col("names")["eng"].alias("en"), F.array_join("variants", ",").alias("variants"))


TIERED = f"""(SELECT term, CASE WHEN gold THEN CASE WHEN n > 0 THEN 'T1' ELSE 'T1g' END WHEN special THEN 'T2' ELSE 'T3' END AS tier, CASE WHEN gold THEN 0.9 WHEN special THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, gold OR special AS is_special, CASE WHEN gold THEN 'A' ELSE '' END AS reason, '未分類' AS category, CASE WHEN gold THEN 'glossary' ELSE 'llm' END AS source
    FROM (SELECT term, category LIKE 'S%' AS gold, length(term) % 3 AS n, brand LIKE '%1%' AS special FROM {TERMS_OF_PART}))"""


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.min("p_type").alias("kind"), F.min("p_brand").alias("brand"))
    gold = F.col("kind").startswith("S")
    variants = F.when(F.length("term") % 3 > 0, F.array_repeat(F.lit("v"), F.length("term") % 3)).otherwise(F.array().cast("array<string>"))
    return K.tiers(p.select("term", F.when(gold, "glossary:x").otherwise("llm:y").alias("source"), variants.alias("variants"), F.col("brand").contains("1").alias("is_special"), F.lit("").alias("reason"), F.lit("").alias("category"), F.lit(0.9).alias("confidence")))


@query(f"SELECT term, tier, confidence, is_special, reason, category FROM {TIERED}")
def tiering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiered(spark, sf_dir).select("term", "tier", "confidence", "is_special", "reason", "category")


@query(f"SELECT CASE WHEN category IS NOT NULL THEN 'category' WHEN tier IS NOT NULL THEN 'tier' WHEN source IS NOT NULL THEN 'source' ELSE 'all' END AS by, coalesce(category, tier, source, '') AS value, count(*) AS n FROM {TIERED} GROUP BY GROUPING SETS ((category), (tier), (source), ())")
def vault_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.vault_stats(_tiered(spark, sf_dir))


@query("SELECT p_type AS category, count(*) AS n, list_sort(list_distinct(list(p_name)))[1] AS first_term, count(DISTINCT p_name) AS n_terms FROM part GROUP BY p_type")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("term"))
    return K.category_counts(p).join(K.members(p), "category").select("category", "n", F.get("terms", F.lit(0)).alias("first_term"), F.size("terms").cast("long").alias("n_terms"))


@query(f"SELECT source, target, arg_min(descr, ord) AS descr FROM {RELATIONS.sql} WHERE source <> target AND source IN (SELECT term FROM {NOTES.sql}) AND target IN (SELECT term FROM {NOTES.sql}) GROUP BY source, target")
def relation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.relations(RELATIONS.df(spark, sf_dir), NOTES.df(spark, sf_dir))


@query(f"WITH l AS (SELECT term AS src, unnest(links) AS dst FROM {NOTES.sql}) SELECT src, dst, CASE WHEN dst LIKE 'domains/%' THEN 'domain' ELSE 'rel' END AS kind FROM l WHERE dst LIKE 'domains/%' OR dst IN (SELECT term FROM {NOTES.sql})")
def edge_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges(G.filter_notes(NOTES.df(spark, sf_dir), limit=None))


LINKS = "(SELECT DISTINCT 's' || s_suppkey AS src, 'domains/n' || s_nationkey AS dst FROM supplier)"


def _supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("domains/n"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit("domain").alias("kind")).distinct()


@query(f"SELECT dst AS id, count(*) AS degree FROM {LINKS} GROUP BY dst")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_supplier_edges(spark, sf_dir))


@query(f"SELECT id, count(DISTINCT n) AS n FROM (SELECT src AS id, dst AS n FROM {LINKS} UNION ALL SELECT dst, src FROM {LINKS}) GROUP BY id")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(_supplier_edges(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT * FROM nation ORDER BY n_name LIMIT 120), l AS (SELECT n_name AS term, s_name AS title, s_acctbal / 10000 AS score FROM f JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal / 10000 >= 0.5) SELECT term, title, score::DOUBLE AS score FROM l")
def bipartite_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bipartite(_nation_cards(spark, sf_dir))[0]


def _nation_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_name").alias("title"), (F.col("s_acctbal") / 10000).cast("double").alias("score"))).alias("wiki"))
    n = table(spark, sf_dir, "nation")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").select(F.col("n_name").alias("term"), "wiki")


@query("SELECT n_name AS term FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal / 10000 >= 0.5)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bipartite(_nation_cards(spark, sf_dir))[1]


@query(
    """WITH r AS (SELECT n_name AS target, c_name AS alias, min(c_custkey) AS ord FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord) AS n FROM r)
    SELECT replace(n.n_name, '_', ' ') AS title, n.n_nationkey::bigint AS pageid, coalesce((SELECT string_agg(replace(alias, '_', ' '), ',' ORDER BY ord) FROM k WHERE k.target = n.n_name AND k.n <= 12), '') AS aliases FROM nation n"""
)
def alias_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as pages and customers as redirects to them."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    page = n.select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_nationkey").cast("long").alias("page_id"), F.lit(0).alias("namespace"), F.col("n_name").alias("title"), F.lit(0).alias("is_redirect"))
    names = c.select((F.col("c_custkey") + 1000).alias("ord"), (F.col("c_custkey") + 1000).alias("page_id"), F.lit(0).alias("namespace"), F.col("c_name").alias("title"), F.lit(1).alias("is_redirect"))
    redirects = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("ord"), (F.col("c_custkey") + 1000).alias("rd_from"), F.lit(0).alias("namespace"), F.col("n_name").alias("title"))
    return I.entries(page.unionByName(names), redirects).select("title", "pageid", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT p_partkey AS term, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 10 <> 0 THEN 'locked' ELSE p_type END AS category, p_partkey % 5 = 0 AS locked FROM part")
def lock_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term"), F.col("p_type").alias("category"))
    old = p.select("term", F.when(F.col("term") % 10 == 0, "").otherwise("locked").alias("category"), (F.col("term") % 5 == 0).alias("locked"))
    return K.keep_locked(p, old, ["category"])


RUNS = "(SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM conversations)"
GRAMS = f"""(SELECT substring(run, i, n) AS w, CASE WHEN i > 1 THEN substring(run, i - 1, 1) ELSE '^' END AS l, CASE WHEN i + n <= length(run) THEN substring(run, i + n, 1) ELSE '$' END AS r
    FROM (SELECT run, i, unnest(range(1, least(7, length(run) - i + 2))) AS n FROM (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM {RUNS})))"""
ENTROPY = "(SELECT w, least(max(hl), max(hr)) AS entropy FROM (SELECT w, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS hl, NULL AS hr FROM (SELECT w, l, count(*) AS c FROM g GROUP BY w, l) GROUP BY w UNION ALL SELECT w, NULL, ln(sum(c)) - sum(c * ln(c)) / sum(c) FROM (SELECT w, r, count(*) AS c FROM g GROUP BY w, r) GROUP BY w) GROUP BY w)"
COHESION = "(SELECT c.w, c.n, ln((c.n / t) / max((a.n / t) * (b.n / t))) AS cohesion FROM (SELECT *, unnest(range(1, length(w))) AS i FROM c WHERE length(w) >= 2 AND n >= 3) c JOIN c a ON a.w = substring(c.w, 1, i) JOIN c b ON b.w = substring(c.w, i + 1), (SELECT sum(length(run)) AS t FROM r) GROUP BY c.w, c.n, t)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("run"))


@query(f"SELECT w, count(*) AS n FROM {GRAMS} GROUP BY w")
def ngram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.counts(W.ngrams(_runs(spark, sf_dir)))


@query(f"WITH g AS (SELECT * FROM {GRAMS}) SELECT w, round(entropy, 5) + 0.0 AS entropy FROM {ENTROPY}")
def branch_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.branch_entropy(W.ngrams(_runs(spark, sf_dir))).select("w", (F.round("entropy", 5) + F.lit(0.0)).alias("entropy"))


@query(f"WITH r AS (SELECT * FROM {RUNS}), c AS (SELECT w, count(*) AS n FROM {GRAMS} GROUP BY w) SELECT w, n, round(cohesion, 5) + 0.0 AS cohesion FROM {COHESION}")
def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    total = runs.agg(F.sum(F.length("run")).alias("t")).first()["t"]
    return W.cohesion(W.counts(W.ngrams(runs)), total, 3).select("w", "n", (F.round("cohesion", 5) + F.lit(0.0)).alias("cohesion"))


def _level(size: int) -> str:
    inside = "SELECT DISTINCT substring(term, i::int, {0}) AS part, score AS s, term AS t, freq AS f FROM (SELECT *, unnest(range(1, length(term) - {0} + 2)) AS i FROM k{1})".format(size, size + 1)
    return f"k{size} AS (SELECT * FROM k{size + 1} UNION ALL SELECT * FROM s WHERE length(term) = {size} AND NOT EXISTS (SELECT 1 FROM ({inside}) p WHERE p.part = s.term AND (p.s > s.score OR (p.s = s.score AND p.t < s.term)) AND s.freq <= floor(p.f * 1.2)))"


@query(
    f"""WITH r AS (SELECT * FROM {RUNS}), g AS (SELECT * FROM {GRAMS}), c AS (SELECT w, count(*) AS n FROM g GROUP BY w),
    s AS (SELECT w AS term, round(least(1.0, 0.35 + 0.08 * cohesion + 0.12 * entropy), 3) AS confidence, n AS freq, round(cohesion + entropy, 3) AS score FROM {COHESION} JOIN {ENTROPY} USING (w) WHERE cohesion >= 1.8 AND entropy >= 0.8),
    k6 AS (SELECT * FROM s WHERE length(term) = 6), {', '.join(_level(n) for n in range(5, 1, -1))} SELECT *, 'newword' AS source FROM k2 ORDER BY score DESC, term LIMIT 800"""
)
def new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.discover(_runs(spark, sf_dir))


@query(
    "SELECT name, coalesce(nullif(trim(regexp_extract(text, '(?m)^term: (.*)$', 1)), ''), regexp_replace(name, '\\.md$', '')) AS term, trim(regexp_extract(text, '(?m)^category: (.*)$', 1)) AS category, coalesce(TRY_CAST(regexp_extract(text, '(?m)^confidence: (.*)$', 1) AS DOUBLE), 0.0) AS confidence, regexp_extract(text, '(?m)^\\*(.+)\\*$', 1) AS gloss, replace(regexp_extract(text, 'variants: \\[(.*)\\]', 1), ', ', ',') AS variants, "
    f"array_to_string(list_distinct(regexp_extract_all(text, '\\[\\[([^\\]|]+)\\]\\]', 1)), ',') <> '' AS linked FROM {NOTE_TEXT.sql}"
)
def note_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_notes(NOTE_TEXT.df(spark, sf_dir)).select("name", "term", "category", "confidence", "gloss", F.array_join("variants", ",").alias("variants"), (F.size("links") > 0).alias("linked"))


@query(
    Fixture(
        "line int, pos int, fields array<string>",
        [
            (1, 0, ["1", "a(b", "x"]),
            (1, 1, ["2", "it's", "NULL"]),
            (2, 0, ["3", ""]),
            (2, 1, ["4", "its", " 0.5"]),
            (2, 2, ["5", "NULL", ""]),
            (2, 3, ["6", "a\\b),(c"]),
        ],
        "SELECT p_partkey + 100, 0, {list}('' || p_partkey, p_name || '(x', 'NULL') FROM part UNION ALL SELECT p_partkey + 100, 1, {list}('' || p_size, '', p_type || 's') FROM part",
    ).sql
)
def sql_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the tuples of a dump."""
    return office.dump_tuples(DUMP.df(spark, sf_dir))


@query(
    Fixture(
        "id int, pos int, object string",
        [(1, 0, '{"term": "a"}'), (1, 1, '{"term": "b", "names": {"eng": "B"}}'), (1, 2, '{"source": "a"}'), (2, 0, '{"term": "c"}'), (2, 1, '{"n": {"m": 1}}')],
        """SELECT p_partkey + 100, 0, '{"term": "' || p_name || '"}' FROM part UNION ALL SELECT p_partkey + 100, 1, '{"term": "' || p_brand || '"}' FROM part
        UNION ALL SELECT p_partkey + 100, 2, '{"source": "' || p_type || '"}' FROM part UNION ALL SELECT p_partkey + 100, 3, '{"n": ' || p_size || '}' FROM part""",
    ).sql
)
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects found in model answers."""
    return office.explode_objects(OBJECTS.df(spark, sf_dir), "id", "text")


def workbook(sheets: dict[str, list[list[str]]]) -> bytes:
    """A small spreadsheet file with inline strings."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            rows = "".join("<row>" + "".join(f'<c r="{chr(65 + k)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(cells) if v) + "</row>" for r, cells in enumerate(sheets[n], 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


SHEETS = {
    "校正": [["建議修正", "誤辨", "誤辨文字數", "類型", "信心", "上下文"], ["生痕化石", "深恆化石、生核化石", "2", "術語", "高", "展覽"], ["生痕化石", "生痕花石", "1", "", "中", "另一"], ["整句修正。", "x", "", "", "", ""], ["跳過", "y", "", "全句修正", "", ""], ["紅碁石", "宏碁石", "", "", "低", ""]],
    "翻譯": [["English", "中文", "日文"], ["Longshan Temple", "龍山寺", "龍山寺"], ["This is far too long to be a name", "台北", "たいぺい"], ["Hongqi", "紅碁石", ""], ["", "生痕化石", "化石"]],
}


def _sheets_of_part(key: int, kind: str) -> dict[str, list[list[str]]]:
    return {
        "校正": [SHEETS["校正"][0], [f"T{key}", f"A{key}、B{key}", "2", "術語", "高", kind], [f"T{key}", f"C{key}", "1", "", "中", "other"]],
        "翻譯": [SHEETS["翻譯"][0], [f"Name {key}", f"T{key}", ""], [f"Other {key}", f"U{key}", ""]],
    }


@query(
    Fixture(
        "term string, kind string, category string, confidence double, context string, variants string, eng string, jpn string",
        [
            ("生痕化石", "correction", "術語", 0.9, "展覽", "深恆化石,生核化石,生痕花石", None, "化石"),
            ("龍山寺", "translation", "", 0.9, "", "", "Longshan Temple", "龍山寺"),
            ("台北", "translation", "", 0.9, "", "", None, "たいぺい"),
            ("紅碁石", "correction", "", 0.5, "", "宏碁石", "Hongqi", None),
        ],
        """SELECT 'T' || p_partkey, 'correction', '術語', 0.9, p_type, 'A' || p_partkey || ',B' || p_partkey || ',C' || p_partkey, 'Name ' || p_partkey, NULL FROM part
        UNION ALL SELECT 'U' || p_partkey, 'translation', '', 0.9, '', '', 'Other ' || p_partkey, NULL FROM part""",
    ).sql
)
def sheet_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary rows of workbooks with a correction sheet and a translation sheet, one for each part."""

    def book(keys: pd.Series, types: pd.Series) -> pd.Series:
        return pd.Series([workbook(_sheets_of_part(k, t)) for k, t in zip(keys, types)])

    # a few bytes of a part make a whole workbook, so parts are dealt by number of cores, not by the bytes of the file
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type").repartition(4 * spark.sparkContext.defaultParallelism)
    made = parts.select(F.concat(F.lit("p"), "p_partkey", F.lit(".xlsx")).alias("path"), F.pandas_udf(book, "binary")("p_partkey", "p_type").alias("content"))
    books = spark.createDataFrame([("f.xlsx", bytearray(workbook(SHEETS)))], "path string, content binary").unionByName(made)
    names = lambda iso: F.try_element_at("names", F.lit(iso)).alias(iso)
    return office.glossary_terms(office.sheets_of(books)).select("term", "kind", "category", "confidence", "context", F.array_join("variants", ",").alias("variants"), names("eng"), names("jpn"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.windowed_commits(table(spark, sf_dir, "events"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
