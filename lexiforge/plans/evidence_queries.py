"""Queries over candidates, evidence, decisions and the dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import phonetic as P
from lexiforge.functions.readings import Reader
from lexiforge.functions.vectors import cosine
from lexiforge.operators import candidates as C
from lexiforge.operators import decide as D
from lexiforge.operators import dictionary as Y
from lexiforge.operators import entities as N
from lexiforge.operators import evidence as E
from lexiforge.operators import lexicon as X
from lexiforge.written import cut

from .registry import GLYPHS, ITEMS, Fixture, han, pick, query, table

PAIRS_SQL = ", ".join(f"'{p}'" for p in P.confusion_pairs())


def dp_sql(pairs: str) -> str:
    """CTEs ending in ``d(a, b, dist)``: weighted distance of the words in ``pairs(a, b)``, without tones.

    Each row of the matrix follows from the one above: a cell is the best of the
    cells to its left, entered from above or diagonally, plus the insertions.
    """
    return f"""pairs AS ({pairs}), dp AS (SELECT a, b, 0 AS i, range(0, length(b) + 1)::DOUBLE[] AS r FROM pairs
      UNION ALL SELECT a, b, i + 1, list_transform(range(0, length(b) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN r[1] + 1
        ELSE least(r[k + 1] + 1, r[k] + CASE WHEN substring(a, i + 1, 1) = substring(b, k, 1) THEN 0 WHEN substring(a, i + 1, 1) || ' ' || substring(b, k, 1) IN ({PAIRS_SQL}) THEN 0.34 ELSE 1 END) END - k))) FROM dp WHERE i < length(a)),
    d AS (SELECT a, b, least(1.0, r[length(b) + 1] / greatest(length(a), length(b))) AS dist FROM dp WHERE i = length(a))"""


GOLDEN = Fixture(
    "a string, b string, d double",
    [("還是", "海蝕", 0.15), ("是", "寺", 0.67), ("深恆化石", "生痕化石", 0.1133), ("生核化石", "生痕化石", 0.4467), ("紅雞", "宏碁", 0.32), ("沿", "岩", 0.0), ("沿", "腦", 0.7667), ("龍山", "龍山寺", 1.0), ("smal", "small", 0.2), ("nut", "lut", 0.1133), ("ring", "ling", 0.25), ("x", "x", 0.0)],
)
HAN_TEXT = Fixture("id int, text string", [(1, "在深恆化石展"), (2, "生痕化石沒錯"), (3, "豆腐沿豆腐腦"), (4, "no han"), (5, "深恆化石和深痕化石")], f"SELECT doc_id + 1000, {han('text')} FROM documents")
HAN_TARGETS = Fixture("ord int, correct string, is_cag boolean", [(1, "生痕化石", True), (2, "豆腐岩", True), (3, "宏碁", False)], f"SELECT min(p_partkey) + 100, {han("substring(replace(p_name, ' ', ''), 1, 3)")}, true FROM part GROUP BY 2")
SCANNED = Fixture("variant string, correct string", [("idiot", "fool"), ("scum", "foam"), ("thth", "th"), ("ciónci", "ción")])
SOUNDS = Fixture("term string, ipa string", [("沿", "j a n T2"), ("岩", "j a n T2"), ("炎", "j a n T2"), ("腦", "n a u T3"), ("空", ""), ("x", "")], "SELECT p_name || ' ' || p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'i' || (p_partkey - p_partkey % 3) END FROM part")
SEED = Fixture("ord int, variant string, correct string", [(1, "深恆", "生痕"), (2, "還是", "海蝕"), (3, "海蝕", "海石"), (4, "深恆", "深痕"), (5, "生痕", "生痕"), (6, "字", "寺"), (7, "後詞", "先詞")], "SELECT p_partkey + 100, split_part(p_name, ' ', 1) || p_size, split_part(p_name, ' ', 2) || p_size % 40 FROM part")
KNOWN = Fixture("ord int, flat string", [(0, "海蝕"), (1, "生痕"), (9, "後詞")], "SELECT min(p_partkey) + 150, split_part(p_name, ' ', 1) || p_size FROM part WHERE p_size % 7 = 0 GROUP BY 2")
COMMON = Fixture("word string", [("還是",), ("現在",)], "SELECT DISTINCT split_part(p_name, ' ', 1) || p_size FROM part WHERE p_size % 11 = 0")
NEIGHBOURS = Fixture("surface string, correct string, d double, is_cag boolean, rank int", [("深恆", "生痕", 0.1133, True, 1), ("深恆", "深痕", 0.2, True, 2), ("還是", "海蝕", 0.15, True, 1), ("沿", "岩", 0.0, False, 1), ("沿", "鹽", 0.05, False, 2)], "SELECT p_brand || '/' || p_size, p_name, CAST(p_partkey % 30 AS DOUBLE) / 100, p_partkey % 3 > 0, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) FROM part")
GRADED = Fixture("variant string, correct string, ambiguous boolean", [("深恆", "生痕", False), ("還是", "海蝕", True)], "SELECT p_brand || '/' || p_size, min(p_name), false FROM part WHERE p_size % 4 = 0 GROUP BY 1 UNION ALL SELECT DISTINCT p_brand || '/' || p_size, p_name, true FROM part WHERE p_size % 3 = 0")
ACOUSTIC = Fixture("span_id string, rank int, candidate string", [("s1", 1, "a"), ("s1", 2, "b"), ("s2", 1, "c"), ("s3", 1, "d"), ("s3", 2, "e"), ("s3", 3, "f")], f"SELECT '' || o, n, 'c' || p % 10 FROM {ITEMS}")
SEMANTIC = Fixture("span_id string, candidate string, score double", [("s1", "b", 0.5), ("s1", "a", 0.0), ("s2", "c", 0.0), ("s3", "f", 0.9), ("s3", "e", 0.4)], f"SELECT '' || o, 'c' || s % 10, d - 0.05 FROM {ITEMS}")
DETECTED = Fixture("seg_id string, detector int, ord int, surface string, correct string", [("c_001", 1, 2, "x", "X2"), ("c_001", 0, 5, "x", "X1"), ("c_001", 0, 1, "y", "Y"), ("c_002", 1, 1, "x", "X3"), ("c_001", 1, 3, "z", "Z")], f"SELECT 'o_' || o, n % 2, p * 10 + n, 'x' || s % 3, '' || p FROM {ITEMS}")
HISTORY = Fixture("span_id string, iter int, value string, who string", [("s1", 1, "wrong", "model"), ("s1", 2, "right", "human"), ("s2", 1, "only", "human"), ("s3", 1, "a", "model"), ("s3", 2, "b", "model")], f"SELECT '' || o, n, 'v' || p % 4, CASE f WHEN 'R' THEN 'human' ELSE 'model' END FROM {ITEMS}")
PATCHES = Fixture("span_id string, value string, review string", [("s1", "better", None), ("s3", None, "正確")], "SELECT '' || o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 2 = 0 THEN '正確' END FROM orders")
CARDS = Fixture("card int, term string, variants array<string>, title string, aliases array<string>, score double", [(1, "alpha", ["alfa", "a1"], "Alpha (letter)", ["First"], 0.8), (2, "beta", [], "Beta", ["alfa"], 0.6), (3, "gamma", ["g"], "Gamma", [], 0.5)], "SELECT p_partkey + 10, p_name || ' ' || p_partkey, {list}(p_type, p_brand), p_type || p_size, {list}(p_brand || p_size, p_name), CAST(p_size AS DOUBLE) / 50 FROM part")
NEAR = Fixture("query int, card int, score double, rank int", [(1, 2, 0.9, 1), (1, 1, 0.7, 2), (1, 3, 0.4, 3), (2, 3, 0.36, 1), (2, 1, 0.2, 2)], f"SELECT o + 10, p + 10, d * 10, n FROM {ITEMS}")
WORD_ASKED = pick("ECONOMY,STANDARD,PROMO,Brand#1,none,Brand#7", "p")
ASKED = Fixture(
    "query int, candidate string",
    [(1, "alfa"), (1, "zeta"), (2, "g"), (2, "Gamma"), (1, "First")],
    f"SELECT DISTINCT o + 10, {WORD_ASKED} FROM {ITEMS}",
    lean=f"SELECT o + 10, w FROM (SELECT DISTINCT o, {WORD_ASKED} AS w FROM {ITEMS})",  # of an order, so found where its lines are
)
PAGES_OF = Fixture("query int, ord int, entity string, title string, score double", [(1, 1, "e1", "Beta", 0.9), (1, 1, "e1", "Delta", 0.7), (1, 1, "e1", "Eta", 0.6), (1, 2, "e2", "Delta", 0.95), (2, 1, "e3", "Zeta", 0.5)], f"SELECT o + 10, n, 'e' || n, 'Page ' || s % 20, t * 10 FROM {ITEMS} UNION ALL SELECT o + 10, n, 'e' || n, 'Other ' || p % 20, d * 10 FROM {ITEMS}")
TAGS = Fixture(
    "doc int, pos int, tag string, start int, stop int, score double",
    [(1, i, t, i, i + 1, 0.9 - 0.01 * i) for i, t in enumerate("B-ORG I-ORG E-ORG B-ORG E-ORG O S-GPE I-PER I-PER O E-LOC B-LOC S-LOC I-ORG E-GPE E-GPE".split())] + [(2, 0, "O", 0, 1, 1.0), (2, 1, "I-ORG", 1, 2, 0.5)],
    f"SELECT o + 10, n, {pick('B-ORG,I-ORG,E-ORG,B-ORG,E-ORG,O,S-GPE,I-PER,I-ORG,O,E-LOC,B-LOC,E-ORG', 'p')}, n, n + 1, d FROM {ITEMS}",
)


#: Ideographs with their tokens, and the distance of each two of them: a matrix row follows from the one above by prefix sums.
READ = "(VALUES " + ", ".join(f"('{c}', {P.syllable_tokens(P.READINGS[c])})" for c in GLYPHS if c in P.READINGS) + ")"
TONE = f"IN ({', '.join(repr(t) for t in P.TONES)})"
WEIGHT = f"CASE WHEN {{0}} {TONE} THEN 0.3 ELSE 1.0 END"
SWAP = f"CASE WHEN {{0}} = {{1}} THEN 0.0 WHEN {{0}} {TONE} AND {{1}} {TONE} THEN 0.3 WHEN {{0}} || ' ' || {{1}} IN ({PAIRS_SQL}) THEN 0.34 ELSE 1.0 END"
GLYPH_DISTANCE = f"""rd(c, t) AS {READ}, pre AS (SELECT c, t, list_transform(range(0, len(t) + 1), lambda j: coalesce(list_sum(list_transform(t[1:j], lambda x: {WEIGHT.format('x')})), 0)) AS p, len(list_filter(t, lambda x: NOT (x {TONE}))) AS sounds FROM rd),
    gd AS (SELECT x.c AS a, y.c AS b, x.t AS ta, y.t AS tb, y.p, greatest(x.sounds, y.sounds) AS most, 0 AS i, y.p::DOUBLE[] AS r FROM pre x, pre y
      UNION ALL SELECT a, b, ta, tb, p, most, i + 1, list_transform(range(0, len(tb) + 1), lambda j: p[j + 1] + list_min(list_transform(range(0, j + 1), lambda k: CASE WHEN k = 0 THEN r[1] + {WEIGHT.format('ta[i + 1]')}
        ELSE least(r[k + 1] + {WEIGHT.format('ta[i + 1]')}, r[k] + {SWAP.format('ta[i + 1]', 'tb[k]')}) END - p[k + 1]))) FROM gd WHERE i < len(ta)),
    glyph AS (SELECT a, b, CASE WHEN a = b THEN 0 ELSE least(1.0, r[len(tb) + 1] / most) END AS g FROM gd WHERE i = len(ta))"""
#: As the statement of SPELLED, for Spark: names meet once for each size, not once for each two parts that have them.
NAMED = "(SELECT DISTINCT p_name, p_size FROM part)"
SPELLED_LEAN = f"SELECT DISTINCT x.p_name, y.p_name FROM {NAMED} AS x JOIN {NAMED} AS y ON split_part(x.p_name, ' ', 1) = split_part(y.p_name, ' ', 1) AND x.p_size = y.p_size AND x.p_name < y.p_name"
SPELLED = Fixture("a string, b string", [("smal", "small"), ("nut", "lut"), ("ring", "ling")], "SELECT DISTINCT x.p_name, y.p_name FROM part AS x JOIN part AS y ON split_part(x.p_name, ' ', 1) = split_part(y.p_name, ' ', 1) AND x.p_size = y.p_size AND x.p_name < y.p_name", SPELLED_LEAN)


def _written(spelled: str) -> str:
    return spelled.replace("x.p_name, y.p_name FROM", f"{han("replace(x.p_name, ' ', '')")}, {han("replace(y.p_name, ' ', '')")} FROM")


WRITTEN = Fixture("a string, b string", [("還是", "海蝕")], _written(SPELLED.derived), _written(SPELLED_LEAN))


@query(
    f"""WITH RECURSIVE {GLYPH_DISTANCE}, {dp_sql(f"SELECT DISTINCT a, b FROM {SPELLED.sql}")},
    w AS (SELECT DISTINCT a, b FROM {WRITTEN.sql}), spot AS (SELECT a, b, unnest(range(1, length(a) + 1))::INT AS i FROM w WHERE length(a) = length(b)),
    h AS (SELECT s.a, s.b, max(CASE WHEN substring(s.a, i, 1) = substring(s.b, i, 1) THEN 0 ELSE coalesce(g, 1) END) AS dist FROM spot s LEFT JOIN glyph ON glyph.a = substring(s.a, i, 1) AND glyph.b = substring(s.b, i, 1) GROUP BY ALL)
    SELECT a, b, d FROM {GOLDEN.sql} UNION ALL SELECT a, b, round(dist, 4) FROM d UNION ALL SELECT a, b, round(dist, 4) FROM h UNION ALL SELECT a, b, 1.0 FROM w WHERE length(a) <> length(b)"""
)
def phonetic_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = SPELLED.df(spark, sf_dir).distinct().unionByName(WRITTEN.df(spark, sf_dir).distinct())
    pairs = GOLDEN.df(spark, sf_dir).select("a", "b").unionByName(pairs)
    return pairs.select("a", "b", F.round(Reader().word_distance(F.col("a"), F.col("b")), 4).alias("d"))


@query(
    f"""WITH RECURSIVE n AS (SELECT DISTINCT p_name AS w FROM part), {dp_sql("SELECT x.w AS a, y.w AS b FROM n x JOIN n y ON x.w <> y.w AND abs(length(x.w) - length(y.w)) <= 0.28 * greatest(length(x.w), length(y.w))")},
    k AS (SELECT a AS surface, b AS correct, round(dist, 4) AS d, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rank FROM d WHERE dist <= 0.28) SELECT surface, correct, d, rank FROM k WHERE rank <= 8"""
)
def phonetic_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("surface")).distinct()
    t = n.select(F.col("surface").alias("ord"), F.col("surface").alias("correct"), F.col("surface").alias("flat"), F.lit(True).alias("is_cag"))
    return C.phonetic_join(n, t).select("surface", "correct", F.round("d", 4).alias("d"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH RECURSIVE {GLYPH_DISTANCE}, near AS (SELECT a, b FROM glyph WHERE g <= 0.28 UNION SELECT '{GLYPHS[-1]}', '{GLYPHS[-1]}'),
    grown AS (SELECT correct, 0 AS i, '' AS word FROM {HAN_TARGETS.sql} WHERE is_cag UNION ALL SELECT correct, i + 1, word || b FROM grown JOIN near ON near.a = substring(correct, i + 1, 1) WHERE i < length(correct)),
    t AS (SELECT DISTINCT correct, word FROM grown WHERE i = length(correct) AND word <> correct),
    c AS (SELECT id, unnest(range(length(text)))::INT AS start, unnest(string_split(text, '')) AS a FROM {HAN_TEXT.sql}),
    w AS (SELECT id, start, a || lead(a, 1) OVER o || lead(a, 2) OVER o AS three, a || lead(a, 1) OVER o || lead(a, 2) OVER o || lead(a, 3) OVER o AS four FROM c WINDOW o AS (PARTITION BY id ORDER BY start))
    SELECT id, start, word AS surface, correct FROM w JOIN t ON word = three UNION ALL SELECT id, start, word, correct FROM w JOIN t ON word = four"""
)
def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.window_scan(HAN_TEXT.df(spark, sf_dir), HAN_TARGETS.df(spark, sf_dir).withColumn("flat", F.col("correct")))


@query(f"SELECT doc_id AS id, i::int AS start, v.variant AS surface, v.correct FROM (SELECT doc_id, text, variant, correct FROM documents CROSS JOIN {SCANNED.sql} WHERE contains(text, variant)) v, unnest(range(length(v.text) - length(v.variant) + 1)) AS r(i) WHERE substring(v.text, (i + 1)::int, length(v.variant)) = v.variant")
def variant_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return C.variant_scan(d, SCANNED.df(spark, sf_dir), "doc_id")


@query(f"SELECT term, array_to_string(list_filter(g, lambda x: x <> term), ',') AS others FROM (SELECT unnest(g) AS term, g FROM (SELECT list_sort(list_distinct(list(term))) AS g FROM {SOUNDS.sql} WHERE ipa <> '' GROUP BY ipa HAVING count(DISTINCT term) > 1))")
def homophone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiforge.operators.knowledge import homophones

    return homophones(SOUNDS.df(spark, sf_dir)).select("term", F.array_join("others", ",").alias("others"))


@query(
    f"""WITH r AS (SELECT s.*, c.word IS NOT NULL OR coalesce(k.ord <= s.ord, false) AS ambiguous FROM {SEED.sql} s LEFT JOIN {COMMON.sql} c ON c.word = s.variant LEFT JOIN {KNOWN.sql} k ON k.flat = s.variant WHERE s.variant <> s.correct AND length(s.variant) >= 2)
    SELECT variant, correct, ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY variant, ambiguous ORDER BY ord) AS n FROM r) WHERE n = 1"""
)
def variant_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.grade_variants(SEED.df(spark, sf_dir), KNOWN.df(spark, sf_dir), COMMON.df(spark, sf_dir)).select("variant", "correct", "ambiguous")


@query(
    f"""WITH s AS (SELECT DISTINCT surface FROM {NEIGHBOURS.sql}), u AS (
      SELECT surface, 0 AS place, g.correct AS candidate, 1.0::DOUBLE AS score, 'variant' AS note FROM s JOIN {GRADED.sql} g ON g.variant = surface AND NOT g.ambiguous
      UNION ALL SELECT n.surface, n.rank, n.correct, round(CASE WHEN n.is_cag THEN greatest(0, 1 - n.d / 0.28) WHEN n.d <= 0 THEN 1 ELSE 0 END, 4), CASE WHEN g.variant IS NULL THEN 'ipa' ELSE 'ambiguous' END
      FROM {NEIGHBOURS.sql} n LEFT JOIN {GRADED.sql} g ON g.variant = n.surface AND g.correct = n.correct AND g.ambiguous),
    o AS (SELECT *, row_number() OVER (PARTITION BY surface, candidate ORDER BY place) AS k FROM u)
    SELECT surface, candidate, score, note, row_number() OVER (PARTITION BY surface ORDER BY place) AS rank FROM o WHERE k = 1"""
)
def acoustic_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = NEIGHBOURS.df(spark, sf_dir)
    return C.acoustic_evidence(n.select("surface").distinct(), GRADED.df(spark, sf_dir), n).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""SELECT a.span_id, coalesce(arg_min(a.candidate, a.rank) FILTER (s.candidate IS NOT NULL), arg_min(a.candidate, a.rank)) AS candidate, bool_or(s.candidate IS NOT NULL) AS hit
    FROM {ACOUSTIC.sql} a LEFT JOIN (SELECT DISTINCT span_id, candidate FROM {SEMANTIC.sql} WHERE score > 0) s ON s.span_id = a.span_id AND s.candidate = a.candidate GROUP BY a.span_id"""
)
def rule_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rule_hits(ACOUSTIC.df(spark, sf_dir), SEMANTIC.df(spark, sf_dir))


FLAGS = Fixture(
    "item string, candidate string, hit boolean, parsed boolean, abandon boolean, xling boolean, common boolean",
    [(f"f{i}", None if i >> 5 & 1 else "x", *(bool(i >> k & 1) for k in range(5))) for i in range(64)],
    f"SELECT o || ':' || n, CASE WHEN p % 4 > 0 THEN 'c' || p END, p % 2 = 0, s % 5 > 0, q < 5, d > 0.05, t > 0.04 FROM {ITEMS}",
)


@query(
    f"""SELECT item, outcome, CASE outcome WHEN 'fix' THEN '錯字' WHEN 'manual' THEN '存疑' ELSE '正確' END AS review, CASE outcome WHEN 'fix' THEN 'auto' WHEN 'manual' THEN 'human' ELSE 'pending' END AS decision
    FROM (SELECT *, CASE WHEN candidate IS NULL OR NOT parsed OR abandon OR (NOT hit AND NOT xling) THEN 'keep' WHEN hit AND NOT common THEN 'fix' ELSE 'manual' END AS outcome FROM {FLAGS.sql})"""
)
def four_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.outcome(*[F.col(c) for c in ("candidate", "hit", "parsed", "abandon", "xling", "common")])
    none = F.array().cast("array<struct<iter:int,value:string,by:string>>")
    rows = FLAGS.df(spark, sf_dir).withColumn("outcome", out)
    return rows.withColumn("e", D.effects(F.col("outcome"), F.col("candidate"), F.lit("o"), none)).select("item", "outcome", "e.review", "e.decision")


REVIEW = "CASE WHEN toxic = 1 THEN '錯字' WHEN quality = 0 THEN '存疑' WHEN quality = 1 THEN '正確' END"


@query(f"SELECT source AS seg_id, CASE max(CASE r WHEN '錯字' THEN 3 WHEN '存疑' THEN 2 WHEN '正確' THEN 1 END) WHEN 3 THEN '錯字' WHEN 2 THEN '存疑' ELSE '正確' END AS verdict FROM (SELECT source, {REVIEW} AS r FROM documents JOIN labels USING (doc_id)) GROUP BY source")
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return D.verdicts(r.select(F.col("source").alias("seg_id"), F.expr(REVIEW).alias("review")))


@query("SELECT doc_id % 16 AS batch, count(*) AS candidates, count(*) FILTER (quality = 1 AND toxic = 1) AS fix, count(*) FILTER (quality = 1 AND toxic = 0) AS keep, count(*) FILTER (quality = 0) AS manual FROM labels GROUP BY ALL")
def judge_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.when(F.col("quality") == 0, "manual").when(F.col("toxic") == 1, "fix").otherwise("keep")
    return D.tally(table(spark, sf_dir, "labels").select((F.col("doc_id") % 16).alias("batch"), o.alias("outcome"), F.lit("c").alias("candidate")), "batch")


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("batch_id"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("d"), F.col("user_id") % 3)).alias("domain"), F.col("event_type").alias("correct"), wrong.alias("wrong"), F.floor("value").cast("string").alias("context"), F.when(F.col("user_id") % 7 == 0, "human").otherwise("auto").alias("decision")
    )


COMMITS = """(SELECT DISTINCT user_id::varchar AS batch_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'd' || (user_id % 3) END AS domain, event_type AS correct, nullif(json_extract_string(props, '$.k'), event_type) AS wrong, floor(value)::bigint::varchar AS context
    FROM events WHERE user_id % 7 <> 0)"""
FREQUENT = "(SELECT json_extract_string(props, '$.k') AS word FROM events GROUP BY 1 HAVING count(*) > (SELECT count(*) / 100.0 FROM events))"


def _frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("word"))
    total = e.agg((F.count("*") / 100.0).alias("least"))
    return e.groupBy("word").agg(F.count("*").alias("n")).join(F.broadcast(total), F.col("n") > F.col("least")).select("word")


COMMITTED = f"""(SELECT 't_' || correct AS term_id, correct, list_sort(list_distinct(list(wrong) FILTER (wrong IS NOT NULL AND wrong NOT IN (SELECT word FROM {FREQUENT} WHERE word IS NOT NULL)))) AS variants, list_sort(list_distinct(list(domain) FILTER (domain <> ''))) AS domains,
    count(DISTINCT (batch_id, wrong, context)) AS n_occurrences, count(DISTINCT batch_id) AS n_batches, round(least(0.99, 0.5 + 0.1 * count(DISTINCT batch_id))::DOUBLE, 4) AS confidence FROM {COMMITS} GROUP BY correct)"""


@query(f"SELECT term_id, correct, coalesce(array_to_string(variants, ','), '') AS variants, coalesce(array_to_string(domains, ','), '') AS domains, n_occurrences, n_batches, confidence FROM {COMMITTED}")
def commit_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Y.commit(Y.occurrences(_commits(spark, sf_dir)), _frequent(spark, sf_dir))
    return c.withColumn("variants", F.array_join("variants", ",")).withColumn("domains", F.array_join("domains", ","))


@query(f"SELECT correct, batch_id, count(*) AS n FROM {COMMITS} GROUP BY ALL")
def occurrence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Y.occurrences(_commits(spark, sf_dir))
    return Y.merge_occurrences(o, o).groupBy("correct", "batch_id").agg(F.count("*").alias("n"))


@query(
    f"""SELECT CASE WHEN pattern IN (SELECT word FROM {FREQUENT} WHERE word IS NOT NULL) OR pattern IN (SELECT DISTINCT event_type FROM events WHERE user_id % 7 <> 0) THEN 'contextual' ELSE 'regex' END AS kind, pattern, replace, term_id
    FROM (SELECT DISTINCT 't_' || correct AS term_id, correct AS replace, wrong AS pattern FROM {COMMITS} WHERE wrong IS NOT NULL)"""
)
def sync_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = spark.createDataFrame([], "word string")
    return Y.export_rules(Y.commit(Y.occurrences(_commits(spark, sf_dir)), nothing), _frequent(spark, sf_dir))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def snapshot_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.keep_last(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query(
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY seg_id, surface ORDER BY detector, ord) AS n FROM {DETECTED.sql})
    SELECT seg_id, surface, correct, seg_id || '_d' || (row_number() OVER (PARTITION BY seg_id ORDER BY detector, ord) - 1) AS span_id FROM k WHERE n = 1"""
)
def detector_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fuse_detectors(DETECTED.df(spark, sf_dir)).select("seg_id", "surface", "correct", "span_id")


def _histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.transform(F.array_sort(F.collect_list(F.struct("iter", "value", "who"))), lambda x: F.struct(x["iter"].alias("iter"), x["value"].alias("value"), x["who"].alias("by")))
    return HISTORY.df(spark, sf_dir).groupBy("span_id").agg(h.alias("history")).withColumn("review", F.lit("存疑"))


@query(f"SELECT span_id, coalesce(arg_min(value, iter) FILTER (who = 'model'), arg_max(value, iter)) AS original, CASE WHEN arg_max(value, iter) <> coalesce(arg_min(value, iter) FILTER (who = 'model'), arg_max(value, iter)) THEN arg_max(value, iter) ELSE '' END AS candidates FROM {HISTORY.sql} GROUP BY span_id")
def span_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _histories(spark, sf_dir).select("span_id", D.span_words(F.col("history"), F.lit(None).cast("array<string>")).alias("w"))
    return w.select("span_id", "w.original", F.array_join("w.candidates", ",").alias("candidates"))


@query(f"SELECT h.span_id, count(*) + coalesce(max((p.value IS NOT NULL)::int), 0) AS n, coalesce(max(p.value), arg_max(h.value, h.iter)) AS current, coalesce(max(p.review), '存疑') AS review FROM {HISTORY.sql} h LEFT JOIN {PATCHES.sql} p ON p.span_id = h.span_id GROUP BY h.span_id")
def span_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = D.patch_spans(_histories(spark, sf_dir), PATCHES.df(spark, sf_dir))
    return p.select("span_id", F.size("history").cast("long").alias("n"), F.element_at("history", -1)["value"].alias("current"), "review")


KNN = "SELECT q.vec_id AS query, c.vec_id AS card, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0"


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, card) AS rank FROM ({KNN})) WHERE rank <= 5")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    # vectors are their own nearest neighbours: one more, then they go
    out = E.knn(v.filter("id % 100 = 0"), v, 6).filter("query <> card")
    return out.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, card)").cast("long")).filter("rank <= 5")


@query(f"SELECT query, count(*) AS n, max(score) AS best FROM ({KNN}) WHERE score >= 0.35 GROUP BY query")
def knn_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return E.knn(v.filter("id % 100 = 0"), v, None, 0.35).filter("query <> card").groupBy("query").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query()
def knn_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours found in the cells nearest to each query; tests measure the recall."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    # vectors are their own nearest neighbours: one more, then they go
    out = E.knn_approximate(v.filter("id % 100 = 0"), v, 6).filter("query <> card")
    return out.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, card)").cast("int")).filter("rank <= 5")


@query("SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], lead(embedding) OVER (PARTITION BY label ORDER BY vec_id)::DOUBLE[]), 6) AS likeness FROM embeddings")
def adjacent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.adjacent_similarity(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("vec_id", "label", F.round("likeness", 6).alias("likeness"))


ANCHORS = f"""(WITH b AS (SELECT n.query, n.rank, n.score AS near, c.* FROM {NEAR.sql} n JOIN {CARDS.sql} c USING (card) WHERE n.score >= 0.35),
    w AS (SELECT query, rank, 0 AS side, unnest(list_concat([term], variants)) AS word, unnest(range(len(variants) + 1)) AS pos, round(near, 4) AS score, 'mind:' || term AS source FROM b
      UNION ALL SELECT query, rank, 1, unnest(list_concat([title], aliases)), unnest(range(len(aliases) + 1)), round(score, 4), 'wiki:' || title || '<' || term FROM b WHERE score >= 0.55)
    SELECT query, word AS flat, score, source FROM (SELECT *, row_number() OVER (PARTITION BY query, word ORDER BY rank, side, pos) AS n FROM w) WHERE n = 1)"""


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = CARDS.df(spark, sf_dir).select("card", "term", "variants", F.array(F.struct("title", "aliases", "score")).alias("wiki"))
    return E.anchors(NEAR.df(spark, sf_dir), cards)


@query(f"SELECT * FROM {ANCHORS}")
def anchor_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchors(spark, sf_dir)


@query(f"SELECT q.query, q.candidate, coalesce(a.score, 0.0)::DOUBLE AS score, coalesce(a.source, 'none') AS source FROM {ASKED.sql} q LEFT JOIN {ANCHORS} a ON a.query = q.query AND a.flat = q.candidate")
def semantic_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.semantic_evidence(ASKED.df(spark, sf_dir), _anchors(spark, sf_dir))


@query(
    f"""WITH u AS (SELECT query, 0 AS side, rank, 0 AS page, 'mind' AS source, card::varchar AS title, score FROM {NEAR.sql} WHERE rank <= 6 AND score >= 0.35
      UNION ALL SELECT query, 1, ord, page, 'wiki', title, score FROM (SELECT *, row_number() OVER (PARTITION BY query, entity ORDER BY score DESC, title) AS page FROM {PAGES_OF.sql} WHERE score >= 0.55) WHERE page <= 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY query, side, title ORDER BY rank, page) AS n FROM u), p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY side, rank, page) AS pos FROM o WHERE n = 1)
    SELECT query, string_agg(CASE source WHEN 'wiki' THEN '維基:' || title ELSE title END, '、' ORDER BY pos) AS line FROM p WHERE pos <= 12 GROUP BY query"""
)
def grounding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.render_grounding(E.grounding(NEAR.df(spark, sf_dir), PAGES_OF.df(spark, sf_dir)))


@query(
    f"""WITH t AS (SELECT *, CASE WHEN contains(tag, '-') THEN split_part(tag, '-', 1) ELSE 'O' END AS place, CASE WHEN contains(tag, '-') THEN split_part(tag, '-', 2) END AS type FROM {TAGS.sql}),
    p AS (SELECT *, lag(place) OVER w AS before, lag(type) OVER w AS type_before FROM t WINDOW w AS (PARTITION BY doc ORDER BY pos)),
    o AS (SELECT *, sum((NOT coalesce(place IN ('I', 'E') AND before IN ('B', 'I') AND type = type_before, false))::int) OVER (PARTITION BY doc ORDER BY pos) AS n FROM p WHERE place <> 'O')
    SELECT doc, min(start) AS start, max(stop) AS stop, min(type) AS type, round(min(score), 4) AS score FROM o GROUP BY doc, n"""
)
def bioes_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.decode_bioes(TAGS.df(spark, sf_dir).withColumnRenamed("stop", "end")).withColumnRenamed("end", "stop")


WORDS = "(SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


@query(f"SELECT word, n, round(n * 1e6 / sum(n) OVER (), 4) AS per_million, n * 1e6 / sum(n) OVER () >= 10 AS common FROM (SELECT word, count(*) AS n FROM {WORDS} GROUP BY word)")
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.frequencies(X.words_of(table(spark, sf_dir, "documents")))
    common = X.common_words(f).select("word", F.lit(True).alias("common"))
    return f.join(common, "word", "left").withColumn("common", F.coalesce("common", F.lit(False)))


#: A word of five letters or more is frequent from so many occurrences in a million on.
FREQUENT = 500


@query(
    f"""WITH RECURSIVE w AS (SELECT * FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) >= 5), f AS (SELECT word, count(*) AS n, sum(count(*)) OVER () AS total FROM w GROUP BY word),
    t AS (SELECT word, n FROM f WHERE round(n * 1e6 / total, 4) >= {FREQUENT}), s AS (SELECT word FROM f WHERE word NOT IN (SELECT word FROM t)),
    {dp_sql("SELECT s.word AS a, t.word AS b FROM s JOIN t ON abs(length(s.word) - length(t.word)) <= 0.28 * greatest(length(s.word), length(t.word)) AND levenshtein(replace(s.word, 'n', 'l'), replace(t.word, 'n', 'l')) <= 0.28 * greatest(length(s.word), length(t.word))")},
    best AS (SELECT a, b, dist FROM (SELECT d.*, row_number() OVER (PARTITION BY a ORDER BY dist, t.n DESC, t.word) AS k FROM d JOIN t ON t.word = d.b WHERE dist <= 0.28) WHERE k = 1)
    SELECT best.a AS pattern, best.b AS replace, round(greatest(0, 1 - best.dist / 0.28), 4) AS score, count(DISTINCT w.doc_id) AS n_docs, round(least(0.99, 0.5 + 0.1 * count(DISTINCT w.doc_id))::DOUBLE, 4) AS confidence
    FROM best JOIN w ON w.word = best.a GROUP BY ALL"""
)
def correction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that look like mis-hearings of frequent ones, their evidence and the rule to export.

    All documents count; frequent is every word from ``FREQUENT`` occurrences in a million on.
    """
    w = X.words_of(table(spark, sf_dir, "documents"), least=5, keep=("doc_id",))
    per_word = cut(w.groupBy("word", "doc_id").agg(F.count("*").alias("c")).groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("n_docs")))
    total = per_word.agg(F.sum("n")).first()[0] or 1
    frequent = F.round(F.col("n") * 1e6 / total, 4) >= FREQUENT
    targets = per_word.filter(frequent).select(F.col("word").alias("correct"), F.col("word").alias("flat"), F.lit(True).alias("is_cag"), F.struct((-F.col("n")).alias("n"), F.col("word").alias("w")).alias("ord"))
    rare = per_word.filter(~frequent)
    best = C.phonetic_join(rare.select(F.col("word").alias("surface")), targets).filter("rank = 1")
    score = P.acoustic_score(F.col("d"), F.lit(P.DEFAULT.fuzzy))
    return best.join(rare, best["surface"] == rare["word"]).select(F.col("surface").alias("pattern"), F.col("correct").alias("replace"), score.alias("score"), "n_docs", F.round(F.least(F.lit(0.99), 0.5 + 0.1 * F.col("n_docs")), 4).alias("confidence"))


@query("SELECT label, count(*) AS n, round(avg(list_cosine_similarity(embedding::DOUBLE[], first::DOUBLE[])), 5) AS likeness FROM embeddings JOIN (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label) USING (label) GROUP BY label")
def label_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return v.join(first, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(cosine(F.col("embedding"), F.col("first"))), 5).alias("likeness"))
