from lexiforge.functions.register import register
from lexiforge.operators import candidates as C
from lexiforge.operators import decide as D
from lexiforge.plans import flows as W


def test_from_transcript_to_rule(spark):
    batches = spark.createDataFrame([("b1", "展覽", "我們去看深恆化石的展覽。豆腐沿很好吃！"), ("b2", "展覽", "深恆化石真好。還是回家。")], "batch_id string, domain string, text string")
    layers = spark.createDataFrame([(1, "生痕化石", True), (2, "海蝕", True), (3, "豆腐岩", True)], "ord int, correct string, is_cag boolean")
    common = spark.createDataFrame([("還是",)], "word string")
    targets = C.merge_targets(layers)
    graded = C.grade_variants(spark.createDataFrame([(1, "豆腐沿", "豆腐岩"), (2, "還是", "海蝕")], "ord int, variant string, correct string"), targets, common)
    segs = W.segment(batches)
    spans = W.detect(segs, targets, graded)
    found = {(r.surface, r.via) for r in spans.collect()}
    assert found == {("深恆化石", "scan"), ("豆腐沿", "variant"), ("還是", "scan")}
    anchors = spans.selectExpr("span_id as query", "'生痕化石' as flat", "0.9D as score", "'mind:x' as source")
    weighed = W.weigh(spans, targets, graded, common, anchors)
    judged = D.judge(weighed, W.rule_answers)
    out = {r.surface: (r.candidate, r.outcome, r.review) for r in judged.collect()}
    assert out == {"深恆化石": ("生痕化石", "fix", "錯字"), "豆腐沿": ("豆腐岩", "keep", "正確"), "還是": ("海蝕", "keep", "正確")}
    assert {r.verdict for r in D.verdicts(judged).collect()} == {"錯字"}
    _, terms, rules = W.learn(judged, batches, common)
    t = terms.first()
    assert (t.correct, t.variants, t.confidence, t.domains) == ("生痕化石", ["深恆化石"], 0.7, ["展覽"])
    assert [(r.kind, r.pattern, r.replace) for r in rules.collect()] == [("regex", "深恆化石", "生痕化石")]
    # without a judge every span is kept
    assert {r.outcome for r in D.judge(weighed).collect()} == {"keep"}


def test_build_terms(spark):
    entities = spark.createDataFrame([(1, "龍山寺", 2, "a", "廟", "地點", "", False), (2, "宏碁", 1, "a", "公司", "公司", "A", True), (3, "龍山寺", 1, "b", "別的", "", "", False)], "ord int, term string, occ int, file string, gloss string, category string, reason string, is_special boolean")
    glossary = spark.createDataFrame([("龍山寺", "龍山寺", ["龍山是"], "", 0.9)], "flat string, term string, variants array<string>, category string, confidence double")
    rel = spark.createDataFrame([(1, "龍山寺", "宏碁", "x"), (2, "龍山寺", "無", "y")], "ord int, source string, target string, descr string")
    terms, relations = W.build_terms(entities, glossary, rel)
    got = {r.term: (r.tier, r.confidence, r.gloss, r.category) for r in terms.collect()}
    assert got == {"龍山寺": ("T1", 0.9, "廟", "地點地名"), "宏碁": ("T2", 0.7, "公司", "組織機構")}
    assert [tuple(r) for r in relations.collect()] == [("龍山寺", "宏碁", "x")]


def test_registered_functions(spark):
    register(spark)
    r = spark.sql("SELECT strip_punct('a, b。c') s, cosine(array(1D, 0D), array(1D, 1D)) c, cosine(array(0D), array(1D)) z, script_of('龍') h, script_of('1') y").first()
    assert (r.s, round(r.c, 4), r.z, r.h, r.y) == ("abc", 0.7071, 0.0, "Han", "Zyyy")
    assert [tuple(x) for x in spark.sql("SELECT * FROM json_objects('{\"a\": 1} {\"b\": 2}')").collect()] == [(0, '{"a": 1}'), (1, '{"b": 2}')]
    assert spark.sql("SELECT * FROM sql_dump_rows('INSERT INTO x VALUES (1,''a'')')").first().fields == ["1", "a"]
