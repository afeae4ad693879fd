"""The table of cards, its index of pages, and small parts around it."""

from pyspark.sql import functions as F

from lexiforge.functions.readings import Reader
from lexiforge.operators import cards as C
from lexiforge.operators import extraction as X
from lexiforge.operators import wiki as W
from lexiforge.operators.vector_index import VectorIndex
from lexiforge.sources import readers
from lexiforge.sources.tablelog import TableLog

NODE = "term string, gloss string, category string, variants array<string>, names map<string,string>, is_special boolean, tier string, source string"


def test_cards_are_embedded_once_and_linked(spark, tmp_path):
    asked = []

    def embed(rows):
        asked.append(sorted(r.term for r in rows.collect()))
        return rows.select("term", F.array(*[(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(100)) / 100).cast("float") for k in range(4)]).alias("vec"))

    node = lambda t, g="": (t, g, "c", [], {}, False, "T1", "llm:x")
    nodes = spark.createDataFrame([node("a"), node("b"), node("c")], NODE)
    log = TableLog(spark, f"file://{tmp_path}/cards", C.CARDS)
    titles = spark.createDataFrame([(i, f"page {t}", [t]) for i, t in enumerate("abcx")], "id long, title string, aliases array<string>")
    vectors = embed(titles.select(F.element_at("aliases", 1).alias("term"), "id")).join(titles.select("id", F.element_at("aliases", 1).alias("term")), "term").select("id", "vec")
    asked.clear()
    pages = VectorIndex(spark, f"file://{tmp_path}/pages").build(vectors)
    assert C.build_cards(nodes, log, None) == {"terms": 3, "embedded": 0, "linked": 0}  # no embedder: cards wait
    assert C.build_cards(nodes, log, embed, pages, titles, k=1) == {"terms": 3, "embedded": 3, "linked": 3}
    held = {r.term: r for r in log.read().collect()}
    assert all(held[t].wiki[0].title == f"page {t}" and held[t].wiki[0].score == 1.0 for t in "abc")
    changed = spark.createDataFrame([node("a"), node("b", "now with a gloss"), node("d")], NODE)
    assert C.build_cards(changed, log, embed, pages, titles, k=1) == {"terms": 3, "embedded": 2, "linked": 2}
    assert asked == [["a", "b", "c"], ["b", "d"]] and {r.term for r in log.read().collect()} == {"a", "b", "d"}
    assert C.resync(lambda: C.build_cards(changed, log, embed), lambda: True).result(120)["embedded"] == 0
    assert C.resync(lambda: 1 / 0, lambda: True).result(60) is None and C.resync(lambda: {"x": 1}, lambda: False).result(60) is None


def test_small_parts(spark, tmp_path):
    v = spark.createDataFrame([("b", "term", "x"), ("a", "term", "x"), ("d", "domain", "x")], "id string, kind string, category string")
    assert [r.id for r in C.term_nodes(v, 1).collect()] == ["a"]
    targets = spark.createDataFrame([("龍", True), ("ab", False)], "correct string, is_cag boolean")
    assert sorted(tuple(r) for r in C.phonetic_index(targets, Reader()).collect()) == [("ab", "a b", False, 0.0, 2), ("龍", "l ʊ ŋ T2", True, 0.28, 2)]
    entries = spark.createDataFrame([("t", ["x", "y"], 1), ("u", [], 2)], "title string, aliases array<string>, pageid long")
    assert W.write_entries(entries, f"file://{tmp_path}/e") == {"entries": 2, "aliases_total": 2}
    names = spark.createDataFrame([("d/wiki-20240101-page.sql",), ("d/wiki-20240601-page.sql",), ("d/zzz.txt",)], "path string")
    assert W.newest_dump(names, "page\\.sql$") == "d/wiki-20240601-page.sql" and W.newest_dump(names, "none") is None
    block = X.taxonomy_block({"人名": "people"}, {"Ada": "人名"}, "未分類")
    asked = X.extraction_questions(spark.createDataFrame([("the text",), (None,)], "text string"), block, known="k1、k2", glossary="g").collect()
    assert asked[0].question.startswith(block + "Known terms: k1、k2\nGlossary:\ng\nText:\nthe text") and asked[1].question.endswith("}") and "人名（people）" in block
    old = spark.createDataFrame([("n.md", "---\nterm: t\npinyin_key: shi4\n---\n"), ("m.md", "---\nipa: new\npinyin_key: old\n---\n")], "name string, text string")
    assert sorted((r.term, r.ipa) for r in readers.parse_notes(old).collect()) == [("m", "new"), ("t", "shi4")]
