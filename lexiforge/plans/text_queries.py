"""Queries over text columns: scripts, guards, splitting, parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import languages as L
from lexiforge.functions import text as T
from lexiforge.operators import chunks as C
from lexiforge.sources.readers import subtitle_text

from .registry import Fixture, han, pick, query, table

STRIP = "regexp_replace({}, '^[\\s\\x{{3000}}]+|[\\s\\x{{3000}}]+$', '', 'g')"
PUNCT_SQL = T.PUNCT.replace("'", "''")
COUNTS = {iso: f"len(regexp_extract_all(text, '[{block}]'))" for _, iso, block in L.BLOCKS}
LANG_SQL = "CASE WHEN n = 0 THEN 'und' " + " ".join(f"WHEN {iso} = n THEN '{iso}'" for iso in COUNTS) + " END"

SENTENCES = f"list_filter(list_transform(regexp_extract_all(text, '[^{T.SENTENCE_END}]*[{T.SENTENCE_END}]|[^{T.SENTENCE_END}]+'), lambda x: {STRIP.format('x')}), lambda x: x <> '')"

MIXED = Fixture(
    "id int, text string",
    [(1, "ab cd龍山9x"), (2, "ab 龍"), (3, "東京タワーへ行く"), (4, "Привет, мир 5 раз"), (5, "这是说明"), (6, "한국어 text"), (7, "12345 ..."), (8, ""), (9, "ไทย العربية हिन्दी தமிழ்"), (10, "龍山寺在台北 Longshan Temple in Taipei")],
    "SELECT doc_id + 1000, CASE doc_id % 6 WHEN 1 THEN translate(text, 'aeiou', '龍山寺在台') WHEN 2 THEN translate(text, 'aeiou', 'がぎぐげご') WHEN 3 THEN translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ') WHEN 4 THEN translate(text, 'aeo', '说这龍') WHEN 5 THEN translate(text, 'nrt', '한국어') ELSE text END FROM documents",
)
NAMES = Fixture(
    "id int, name string, iso string",
    [(1, "「Longshan Temple」", "eng"), (2, "This is a far too long name for one", "eng"), (3, "one two three four five", "eng"), (4, "龍山寺", "cmn"), (5, "這是一個非常非常非常非常非常長的名稱", "cmn"), (6, "All right.", "eng"), (7, "a「b", "deu"), (8, " 'Bahnhof' ", "deu"), (9, "", "fra"), (10, None, "fra")],
    f"SELECT p_partkey + 1000, CASE p_partkey % 6 WHEN 0 THEN '「' || p_name || '」' WHEN 1 THEN p_name || ' ' || p_type || ' ' || p_brand || ' one two' WHEN 2 THEN {han('p_name')} WHEN 3 THEN p_name || '.' WHEN 4 THEN ' ' || chr(39) || p_type || chr(39) || ' ' ELSE p_brand END, {pick('eng,cmn,deu,fra,jpn', 'p_partkey')} FROM part",
)
TERMS = Fixture("id int, term string", [(1, "龍山寺"), (2, "ok"), (3, "OKAY"), (4, "12.5"), (5, "a, b"), (6, "這是。句子"), (7, "well thank you"), (8, "abcdefghijklmnopq"), (9, "abcdefghijklmnop"), (10, "  term  "), (11, "Why?"), (12, None), (13, "3D列印")], f"SELECT conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT -p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ',' WHEN 1 THEN '  ' || p_type || '  ' WHEN 2 THEN '' || p_partkey WHEN 3 THEN {han('p_name')} WHEN 4 THEN p_name ELSE p_name || ' ' || p_name END FROM part")
CATEGORY = Fixture("id int, category string", [(1, "人名"), (2, "知名人物"), (3, "大學單位"), (4, "abbr"), (5, "會議流程"), (6, ""), (7, None), (8, "未分類"), (9, "別的"), (10, " 作品或標題 "), (11, "系統平台公司")], f"SELECT page_id + 1000, CASE page_id % 9 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE ' ' || {pick(','.join(w for words in T.CATEGORIES.values() for w in words), 'page_id')} || {pick('單位,人,x, ,系統', 'page_id')} END FROM pages")
SUBTITLE = Fixture("id int, text string", [(1, "1\n00:00:01,000 --> 00:00:02,000\nhello\n\n2\n00:00:03,000 --> 00:00:04,000\n 你好 \n"), (2, "no times here\n42\nx"), (3, "")], "SELECT conv_id * 1000 + turn + 10, turn || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || text || chr(10) || chr(10) || '42' || chr(10) || '  ' || role || ' ' FROM conversations")
TRANSCRIPT = Fixture(
    "id int, text string",
    [(1, "zh: 丟\n--- 1\nen: hi\nzh: 好\n--- 2\n嗨\nplain"), (2, "--- 1\nzh: 龍山寺\nen: Longshan Temple\nja: 龍山寺\nzh: 在台北\n---\n補充\n--- 2\nEnglish: only\n"), (3, "沒有標記\nen: none"), (4, "")],
    f"SELECT doc_id + 1000, 'zh: ' || {han("split_part(text, ' ', 1)")} || chr(10) || '--- 1' || chr(10) || 'en: ' || replace(replace(CASE WHEN doc_id % 2 = 0 THEN translate(text, 'ao', '龍山') ELSE text END, '. ', '.' || chr(10) || '--- ' || doc_id % 7 || chr(10) || 'zh: '), ', ', ',' || chr(10) || {pick('en: ,note ,ja: ,fr: ', 'doc_id')}) FROM documents",
)
DETECT = Fixture("id int, text string", [(1, "這是⚠️注意(?可能)的字"), (2, "好（？要查）嗎"), (3, "plain (note) stays"), (4, None)], "SELECT doc_id + 1000, CASE doc_id % 3 WHEN 0 THEN replace(text, ', ', '（？要查）') WHEN 1 THEN replace(replace(text, ', ', '(?'), '. ', ')⚠️') ELSE replace(text, ', ', '(note)⚠') END FROM documents")
LOCAL = Fixture("id int, context string, surface string", [(1, "第一句。生核，化石在這。最後", "生核化石"), (2, "沒有這個詞的一句話", "龍山"), (3, "", "龍山"), (4, "Hello there! General, Kenobi.", "GeneralKenobi")], "SELECT doc_id + 1000, text, CASE doc_id % 3 WHEN 0 THEN split_part(text, ' ', 5) || split_part(text, ' ', 6) WHEN 1 THEN split_part(text, ' ', 9) ELSE 'qqqq' || doc_id END FROM documents")
BRACKET = Fixture("id int, context string, word string", [(1, "豆腐沿很好吃豆腐沿", "豆腐沿"), (2, "abc", "z"), (3, "a.b.c", "."), (4, "abc", "c")], "SELECT doc_id + 1000, text, CASE doc_id % 3 WHEN 0 THEN split_part(text, ' ', 3) WHEN 1 THEN 'zzzq' ELSE split_part(text, ' ', 7) END FROM documents")
JUDGE = Fixture("id int, answer string", [(1, 'x {"abandon": false, "xling": true} y'), (2, '{"abandon": true} {"abandon": false}'), (3, "no json"), (4, '{"xling": true}'), (5, "{broken"), (6, '{"abandon": false}'), (7, None)], """SELECT doc_id + 1000, CASE doc_id % 5 WHEN 0 THEN 'x {"abandon": false, "xling": ' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END || '} y' WHEN 1 THEN '{"abandon": ' || CASE WHEN quality = 1 THEN 'true' ELSE 'false' END || '}'
    WHEN 2 THEN '{broken ' || doc_id WHEN 3 THEN 'no json' ELSE '{"xling": true} {"abandon": false}' END FROM labels""")
FILES = Fixture("rel string, override string", [("a/terms.xlsx", None), ("b/字幕.docx", None), ("b/字幕2.docx", "extract"), ("c/talk.srt", None), ("d/Slides.PPTX", None), ("e/transcript.pdf", None), ("f/clean.pdf", "exclude"), ("g/noext", None)], f"SELECT 'p/' || {pick('字幕,talk,transcript,notes,L3,逐字', 'page_id')} || page_id || {pick('.xlsx,.docx,.PPTX,.srt,.pdf,', 'page_id % 5 + page_id')}, CASE page_id % 7 WHEN 0 THEN 'extract' WHEN 1 THEN 'exclude' END FROM pages")
VARIANTS = Fixture("id int, raw string, correct string", [(1, "生核化石、深恆化石,生核化石;123 生痕化石", "生痕化石"), (2, "a/b；c，a", "c"), (3, "", "x"), (4, "ok、好的", "好")], "SELECT p_partkey + 1000, p_name || '、' || p_type || ',' || p_brand || ';' || p_partkey || ' ' || p_name || '/x' || p_size, p_brand FROM part")
MAPS = Fixture("id int, a string, b string, c string", [(1, "old", None, "new"), (2, None, "n", None), (3, "x", "y", "z")], "SELECT p_partkey + 1000, CASE WHEN p_partkey % 3 > 0 THEN p_brand END, CASE WHEN p_partkey % 4 > 0 THEN p_type END, CASE WHEN p_partkey % 5 > 0 THEN p_name END FROM part")
SOURCES = Fixture("id int, text string, eng string, jpn string", [(1, "the Longshan temple", "Longshan", "龍山寺"), (2, "龍山寺", None, "龍山寺"), (3, "", "x", "")], f"SELECT doc_id + 1000, text, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE split_part(text, ' ', 2) END, CASE WHEN doc_id % 3 = 0 THEN {han("split_part(text, ' ', 3)")} ELSE split_part(text, ' ', 1) END FROM documents")
FENCED = Fixture("id int, answer string", [(1, '```json\n{"a": 1}\n```'), (2, '{"a": [1, 2]}'), (3, "not json {"), (4, ""), (5, "[1, 2, 3]")], """SELECT conv_id * 1000 + turn + 10, CASE turn % 4 WHEN 0 THEN '```json' || chr(10) || '{"a": "' || t || '"}' || chr(10) || '```' WHEN 1 THEN '["' || t || '"]' WHEN 2 THEN '{"a": ' || t ELSE '```' || chr(10) || '[1, 2]' || chr(10) || '```' END
    FROM (SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '"', ''), chr(92), ''), chr(10), ' '), chr(9), ' '), chr(13), ' ') AS t FROM conversations)""")


@query(f"SELECT doc_id, eng, cmn, {LANG_SQL} AS lang FROM (SELECT *, greatest({', '.join(COUNTS)}) AS n FROM (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in COUNTS.items())} FROM documents))")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = L.script_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n["eng"].cast("long").alias("eng"), n["cmn"].cast("long").alias("cmn"), L.primary_lang(F.col("text")).alias("lang"))


@query(
    f"""WITH c AS (SELECT id, text, {', '.join(f'{v} AS {k}' for k, v in COUNTS.items())} FROM {MIXED.sql}),
    d AS (SELECT * REPLACE (CASE WHEN jpn > 0 THEN 0 ELSE cmn END AS cmn) FROM c), m AS (SELECT *, greatest({', '.join(COUNTS)}) AS n FROM d), l AS (SELECT *, {LANG_SQL} AS lang FROM m)
    SELECT id, lang, lang || '-' || CASE WHEN lang = 'cmn' THEN CASE WHEN regexp_matches(text, '[{L.SIMPLIFIED_HINT}]') THEN 'Hans' ELSE 'Hant' END {' '.join(f"WHEN lang = '{k}' THEN '{v}'" for k, v in L.TAG_SCRIPT.items())} ELSE 'Zyyy' END AS tag,
    CASE WHEN n = 0 THEN 'und' ELSE array_to_string(list_filter([{', '.join(f"CASE WHEN {k} > 0 THEN '{k}' END" for k in COUNTS)}], lambda x: x IS NOT NULL), ',') END AS present FROM l"""
)
def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = MIXED.df(spark, sf_dir).select("id", F.explode(F.array(L.language_facts(F.col("text")))).alias("f"))
    return facts.select("id", "f.lang", "f.tag", F.array_join("f.present", ",").alias("present"))


RUN_SCRIPT = "CASE " + " ".join(f"WHEN regexp_matches(run, '^[{b}]') THEN '{s}'" for s, _, b in L.BLOCKS) + " END"


@query(f"SELECT id, pos, run, {RUN_SCRIPT} AS script FROM (SELECT id, unnest(r) AS run, unnest(range(len(r))) AS pos FROM (SELECT id, regexp_extract_all(text, '{L.run_pattern()}') AS r FROM {MIXED.sql}))")
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the script is told after the runs became rows, in generated code
    found = MIXED.df(spark, sf_dir).select("id", F.posexplode(L.runs(F.col("text"))).alias("pos", "run"))
    return found.select("id", F.col("pos").cast("long"), "run", L.char_script(F.substring("run", 1, 1)).alias("script"))


REGISTRY = Fixture("alias string, iso string, script string, max_chars int, max_words int", L.registry_rows())


@query(f"SELECT iso, script, max_chars, max_words, count(*) AS n FROM documents JOIN {REGISTRY.sql} r ON lower(trim(lang)) = alias GROUP BY ALL")
def language_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("alias", F.lower(F.trim("lang")))
    return d.join(F.broadcast(L.languages(spark)), "alias").groupBy("iso", "script", "max_chars", "max_words").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda x: length(x))) AS longest, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(f"SELECT doc_id, length(b) AS n, md5(b) AS digest FROM (SELECT doc_id, regexp_replace(text, '[{PUNCT_SQL}]+', '', 'g') AS b FROM documents)")
def bare_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_punct(F.col("text")).alias("b")).select("doc_id", F.length("b").cast("long").alias("n"), F.md5("b").alias("digest"))


FILLER_SQL = ", ".join(f"'{x}'" for x in T.FILLERS)


def _term_sql(c: str) -> str:
    ascii_signs = T.ASCII_SIGNS.replace("'", "''")
    return f"({c} <> '' AND length({c}) <= {T.MAX_TERM} AND NOT regexp_matches({c}, '{T.CJK_SIGNS}') AND NOT regexp_matches({c}, '{ascii_signs}') AND NOT regexp_matches({c}, '^[0-9.,]+$') AND lower({c}) NOT IN ({FILLER_SQL}))"


@query(f"SELECT id, {_term_sql('t')} AS ok FROM (SELECT id, {STRIP.format('coalesce(term, chr(32))')} AS t FROM {TERMS.sql})")
def term_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TERMS.df(spark, sf_dir).select("id", T.is_term(F.col("term")).alias("ok"))


@query(f"SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE {_term_sql('w')} AND NOT regexp_matches(w, '\\s') GROUP BY w")
def term_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return w.filter(T.is_term(F.col("w")) & ~F.col("w").rlike("\\s")).groupBy("w").agg(F.count("*").alias("n"))


@query(
    f"""WITH n AS (SELECT id, iso, regexp_replace({STRIP.format("coalesce(name, '')")}, '^[「」『』"'']+|[「」『』"'']+$', '', 'g') AS t FROM {NAMES.sql}),
    l AS (SELECT *, iso IN ('cmn', 'jpn', 'kor', 'tha') AS dense FROM n)
    SELECT id, CASE WHEN length(t) > CASE WHEN dense THEN 16 ELSE 28 END OR regexp_matches(t, '{T.NAME_END}') OR regexp_matches(t, '{T.CJK_SIGNS}') OR regexp_matches(t, '[「」。]')
    OR (NOT dense AND len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) > 4) THEN '' ELSE t END AS name FROM l"""
)
def name_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NAMES.df(spark, sf_dir).select("id", T.clean_name(F.col("name"), F.col("iso")).alias("name"))


CATEGORY_SQL = "CASE WHEN c = '' OR c = '未分類' THEN '未分類' " + " ".join(f"WHEN c = '{k}' THEN c" for k in T.CATEGORIES) + " " + " ".join(f"WHEN regexp_matches(c, '{'|'.join(v)}') THEN '{k}'" for k, v in T.CATEGORIES.items()) + " ELSE '未分類' END"


@query(f"SELECT id, {CATEGORY_SQL} AS category FROM (SELECT id, {STRIP.format('''coalesce(category, '')''')} AS c FROM {CATEGORY.sql})")
def category_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CATEGORY.df(spark, sf_dir).select("id", T.canon_category(F.col("category")).alias("category"))


LINES = "list_transform(string_split(text, chr(10)), lambda x: " + STRIP.format("x") + ")"


@query(f"SELECT id, array_to_string(list_filter({LINES}, lambda x: NOT regexp_matches(x, '^[0-9]+$|-->|^\\s*$')), chr(10)) AS said FROM {SUBTITLE.sql}")
def subtitle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SUBTITLE.df(spark, sf_dir).select("id", subtitle_text(F.col("text")).alias("said"))


ANCHOR = T.ANCHOR_PREFIX.removeprefix("(?i)")
DROP = T.DROP_PREFIX.removeprefix("(?i)")


@query(
    f"""SELECT id, array_to_string(list_filter(list_transform({LINES}, lambda s: CASE WHEN s = '' OR regexp_matches(s, '{T.MARKER}') OR regexp_matches(s, '{DROP}', 'i') THEN ''
    WHEN regexp_matches(s, '{ANCHOR}', 'i') THEN {STRIP.format(f"regexp_replace(s, '{ANCHOR}', '', 'i')")} WHEN regexp_matches(s, '{T.HAN}') THEN s ELSE '' END), lambda x: x <> ''), chr(10)) AS anchor,
    len(list_filter({LINES}, lambda x: regexp_matches(x, '{T.NUMBERED}'))) >= 2 AS marked FROM {TRANSCRIPT.sql}"""
)
def anchor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TRANSCRIPT.df(spark, sf_dir).select("id", T.extract_anchor(F.col("text")).alias("anchor"), T.has_markers(F.col("text")).alias("marked"))


def _units_sql(source: str) -> str:
    return f"""WITH l AS (SELECT id, unnest(x) AS line, unnest(range(len(x))) AS pos FROM (SELECT id, {LINES} AS x FROM {source})),
    u AS (SELECT *, sum(regexp_matches(line, '{T.NUMBERED}')::int) OVER (PARTITION BY id ORDER BY pos) AS unit, regexp_extract(line, '{C.PREFIX}', 1) AS p FROM l),
    k AS (SELECT u.*, r.iso AS known FROM u LEFT JOIN {REGISTRY.sql} r ON lower(p) = r.alias WHERE unit > 0 AND NOT regexp_matches(line, '{T.MARKER}')),
    s AS (SELECT id, unit, pos, coalesce(known, CASE WHEN regexp_matches(line, '{T.HAN}') THEN 'cmn' END) AS iso, CASE WHEN known IS NULL THEN line ELSE {STRIP.format(f"regexp_replace(line, '{C.PREFIX}', '')")} END AS said FROM k)
    SELECT id, unit::bigint AS unit, iso, trim(string_agg(said, ' ' ORDER BY pos)) AS text FROM s WHERE iso IS NOT NULL GROUP BY id, unit, iso HAVING trim(string_agg(said, ' ' ORDER BY pos)) <> ''"""


@query(_units_sql(TRANSCRIPT.sql))
def unit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.parse_units(TRANSCRIPT.df(spark, sf_dir)).withColumn("unit", F.col("unit").cast("long"))


RENDERED = "(SELECT conv_id AS id, string_agg('--- ' || turn || chr(10) || CASE role WHEN 'user' THEN 'en: ' WHEN 'assistant' THEN 'fr: ' ELSE 'note: ' END || replace(text, chr(10), ' '), chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id)"


@query(_units_sql(RENDERED))
def unit_parse_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    tag = F.when(F.col("role") == "user", "en: ").when(F.col("role") == "assistant", "fr: ").otherwise("note: ")
    line = F.concat(F.lit("--- "), F.col("turn").cast("string"), F.lit("\n"), tag, F.replace("text", F.lit("\n"), F.lit(" ")))
    rows = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return C.parse_units(rows).withColumn("unit", F.col("unit").cast("long"))


@query(f"SELECT id, regexp_replace(coalesce(text, ''), '⚠️?|[(（][?？][^)）]*[)）]', '', 'g') AS clean FROM {DETECT.sql}")
def detection_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DETECT.df(spark, sf_dir).select("id", T.clean_detection(F.col("text")).alias("clean"))


@query(
    f"""SELECT id, coalesce(list_filter(s, lambda x: contains(regexp_replace(x, '[{PUNCT_SQL}]+', '', 'g'), regexp_replace(surface, '[{PUNCT_SQL}]+', '', 'g')))[1], nullif(substring(text, 1, 80), ''), surface) AS sentence
    FROM (SELECT id, surface, context AS text, {SENTENCES.replace('(text,', '(context,')} AS s FROM {LOCAL.sql})"""
)
def local_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LOCAL.df(spark, sf_dir).select("id", T.local_sentence(F.col("context"), F.col("surface")).alias("sentence"))


@query(f"SELECT id, CASE WHEN word <> '' AND instr(context, word) > 0 THEN substring(context, 1, instr(context, word) - 1) || '[' || word || ']' || substring(context, instr(context, word) + length(word)) ELSE context END AS marked FROM {BRACKET.sql}")
def bracket_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BRACKET.df(spark, sf_dir).select("id", T.bracket_first(F.col("context"), F.col("word")).alias("marked"))


@query("SELECT page_id, CASE WHEN t = '' THEN 'term' ELSE substring(t, 1, 80) END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[\\\\/:*?\"<>|\\s]+', '_', 'g'), '^_+|_+$', '', 'g') AS t FROM pages)")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query(f"SELECT doc_id, substring(coalesce(list_filter({LINES}, lambda x: x <> '')[1], ''), 1, 60) AS title, length(text) <= 6000 AS fits FROM documents")
def titles_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.doc_title(F.col("text")).alias("title"), T.fits(F.col("text")).alias("fits"))


@query(
    f"""SELECT id, ok AND valid AS parsed, CASE WHEN valid THEN coalesce(TRY_CAST(json_extract_string(j, '$.abandon') AS boolean), true) ELSE true END AS abandon, CASE WHEN valid THEN coalesce(TRY_CAST(json_extract_string(j, '$.xling') AS boolean), false) ELSE false END AS xling
    FROM (SELECT id, raw <> '' AS ok, raw <> '' AND json_valid(raw) AS valid, CASE WHEN json_valid(raw) THEN raw::json END AS j FROM (SELECT id, regexp_extract(coalesce(answer, ''), '(?s)(\\{{.*?\\}})', 1) AS raw FROM {JUDGE.sql}))"""
)
def judge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JUDGE.df(spark, sf_dir).select("id", T.judge_answer(F.col("answer")).alias("j")).select("id", "j.*")


@query(f"SELECT id, t <> '' AND json_valid(t) AS parses FROM (SELECT id, {STRIP.format('''regexp_replace(answer, '(?s)^\\s*```[a-zA-Z]*|```\\s*$', '', 'g')''')} AS t FROM {FENCED.sql})")
def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FENCED.df(spark, sf_dir).select("id", T.json_parses(F.col("answer")).alias("parses"))


@query(f"SELECT rel, auto, coalesce(override, auto) AS decision FROM (SELECT rel, override, CASE WHEN lower(regexp_extract(rel, '(\\.[^./]*)$', 1)) IN ('.xlsx', '.docx', '.pptx', '.pdf') AND NOT regexp_matches(rel, '{T.DIRTY_NAME}') THEN 'extract' ELSE 'exclude' END AS auto FROM {FILES.sql})")
def source_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = FILES.df(spark, sf_dir)
    return f.select("rel", T.auto_decision(F.col("rel")).alias("auto"), T.effective_decision(F.col("override"), F.col("rel")).alias("decision"))


@query(
    f"""WITH v AS (SELECT id, correct, unnest(p) AS v, unnest(range(len(p))) AS pos FROM (SELECT id, correct, list_filter(regexp_split_to_array(raw, '[、,，;；/\\s]+'), lambda x: x <> '') AS p FROM {VARIANTS.sql})),
    k AS (SELECT id, v, min(pos) AS pos FROM v WHERE NOT regexp_matches(v, '^[0-9]+$') AND {_term_sql('v')} AND v <> correct GROUP BY id, v)
    SELECT id, string_agg(v, '|' ORDER BY pos) AS variants FROM k GROUP BY id"""
)
def variant_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = VARIANTS.df(spark, sf_dir).select("id", T.clean_variants(T.split_variants(F.col("raw")), F.col("correct")).alias("v"))
    return v.filter(F.size("v") > 0).select("id", F.array_join("v", "|").alias("variants"))


@query(f"SELECT id, k, v FROM (SELECT id, unnest(['a', 'b']) AS k, unnest([coalesce(b, a), coalesce(c, b)]) AS v FROM {MAPS.sql}) WHERE v IS NOT NULL")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b")), F.create_map(F.lit("a"), F.col("b"), F.lit("b"), F.col("c"))
    return MAPS.df(spark, sf_dir).select("id", F.explode(T.merge_maps(old, new)).alias("k", "v")).filter("v is not null")


@query(f"SELECT id, k, v, CASE WHEN contains(text, v) THEN 'text' ELSE 'gen' END AS src FROM (SELECT id, text, unnest(['eng', 'jpn']) AS k, unnest([eng, jpn]) AS v FROM {SOURCES.sql}) WHERE v <> ''")
def name_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = T.migrate_names(F.create_map().cast("map<string,string>"), F.col("eng"), F.col("jpn"))
    s = SOURCES.df(spark, sf_dir).select("id", names.alias("n"), T.name_sources(names, F.col("text")).alias("s"))
    return s.select("id", "s", F.explode("n").alias("k", "v")).select("id", "k", "v", F.col("s")[F.col("k")].alias("src"))


@query(
    f"""WITH RECURSIVE p AS (SELECT doc_id, {SENTENCES} AS s FROM documents),
    q AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN length(x) > 400 THEN list_transform(range((length(x) + 399) // 400), lambda i: substring(x, i * 400 + 1, 400)) ELSE [x] END)) AS s FROM p),
    f AS (SELECT doc_id, s, 1 AS i, length(s[1]) AS n, 0 AS chunk FROM q WHERE len(s) > 0
      UNION ALL SELECT doc_id, s, i + 1, CASE WHEN n + length(s[i + 1]) > 400 THEN length(s[i + 1]) ELSE n + length(s[i + 1]) END, chunk + (n + length(s[i + 1]) > 400)::int FROM f WHERE i < len(s))
    SELECT doc_id, chunk, sum(length(s[i]))::bigint AS chars, md5(string_agg(s[i], '' ORDER BY i)) AS digest FROM f GROUP BY doc_id, chunk"""
)
def pack_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.pack_greedy(table(spark, sf_dir, "documents"), "doc_id", T.split_sentences(F.col("text")))
    return out.select(F.col("id").alias("doc_id"), "chunk", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


PIECES = f"""p AS (SELECT doc_id, {SENTENCES} AS s FROM documents),
    q AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN length(x) > 400 THEN list_transform(range((length(x) + 399) // 400), lambda i: substring(x, i * 400 + 1, 400)) ELSE [x] END)) AS s FROM p)"""


@query(
    f"""WITH RECURSIVE {PIECES},
    f AS (SELECT doc_id, s, 1 AS i, [s[1]] AS cur, 0 AS chunk FROM q WHERE len(s) > 0
      UNION ALL SELECT doc_id, s, i + 1, CASE WHEN passed THEN [cur[len(cur)], s[i + 1]] ELSE list_append(cur, s[i + 1]) END, chunk + passed::int
      FROM (SELECT *, list_sum(list_transform(cur, lambda x: length(x))) + length(s[i + 1]) > 400 AS passed FROM f WHERE i < len(s)))
    SELECT doc_id, chunk, md5(array_to_string(arg_max(cur, i), '')) AS digest FROM f GROUP BY doc_id, chunk"""
)
def pack_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.pack_overlap(table(spark, sf_dir, "documents"), "doc_id", T.split_sentences(F.col("text")))
    return out.select(F.col("id").alias("doc_id"), "chunk", F.md5("text").alias("digest"))


@query(
    f"""WITH p AS (SELECT doc_id, {SENTENCES} AS s FROM documents),
    q AS (SELECT doc_id, flatten(list_transform(s, lambda x: CASE WHEN length(x) > 400 THEN list_transform(range((length(x) + 399) // 400), lambda i: substring(x, i * 400 + 1, 400)) ELSE [x] END)) AS s FROM p),
    a AS (SELECT doc_id, unnest(s) AS t, unnest(range(len(s))) AS pos FROM q)
    SELECT doc_id, pos, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS begins, length(t) AS n FROM a"""
)
def atom_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = C.atoms(table(spark, sf_dir, "documents"), "doc_id", T.split_sentences(F.col("text")))
    return a.select(F.col("id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.col("start").cast("long").alias("begins"), (F.col("end") - F.col("start")).cast("long").alias("n"))


@query(
    f"""WITH RECURSIVE {PIECES}, o AS (SELECT doc_id, list_filter(s, lambda x: x <> '') AS s FROM q),
    f AS (SELECT doc_id, s, 1 AS i, 0 AS pos, length(s[1]) AS n, 0 AS chunk FROM o WHERE len(s) > 0
      UNION ALL SELECT doc_id, s, i + 1, pos + length(s[i]) + 1, CASE WHEN passed THEN length(s[i + 1]) ELSE n + length(s[i + 1]) END, chunk + passed::int
      FROM (SELECT *, n >= 200 AND n + length(s[i + 1]) > 400 AS passed FROM f WHERE i < len(s))),
    c AS (SELECT doc_id AS id, chunk, min(pos)::int AS start, any_value(array_to_string(s, chr(10))) AS whole FROM f GROUP BY doc_id, chunk),
    e AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY id ORDER BY chunk), length(whole))::int AS stop FROM c)
    SELECT id, chunk, start, stop AS "end", md5(substring(whole, start + 1, stop - start)) AS digest FROM e"""
)
def offset_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores over each document's atoms; no vectors, so chunks run up to the limit."""
    out = C.offset_chunks(C.atoms(table(spark, sf_dir, "documents"), "doc_id", T.split_sentences(F.col("text"))))
    return out.select("id", "chunk", "start", "end", F.md5("core").alias("digest"))


@query("SELECT doc_id, substring(sha256(concat_ws('｜', nullif(lang, ''), nullif(source, ''), nullif(text, ''))), 1, 16) AS hash FROM documents")
def card_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.card_hash(F.col("lang"), F.col("source"), F.col("text")).alias("hash"))
