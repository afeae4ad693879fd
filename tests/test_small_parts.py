"""Languages of atoms and chunks, packing, lists of a term, the special note and the figures of the graph."""

import random

from pyspark.sql import functions as F

from lexiforge.operators import chunks as H
from lexiforge.operators import graph as G
from lexiforge.operators import knowledge as K
from lexiforge.sources import stores


def test_atoms_keep_the_languages_of_their_unit(spark):
    text = "--- 1\nzh: 龍山寺在台北。很好！\nen: Longshan Temple.\nja: 龍山寺\n--- 2\nzh: 海蝕。\n--- 3\nen: only\n"
    rows = spark.createDataFrame([("x", text), ("y", "zh: 一句。\nen: no\n二句。"), ("z", ""), ("n", None)], "id string, text string")
    got = {(r.id, r.pos): r for r in H.unit_atoms(rows).collect()}
    assert [(k, got[k].text) for k in sorted(got)] == [(("x", 0), "龍山寺在台北。"), (("x", 1), "很好！"), (("x", 2), "海蝕。"), (("y", 0), "一句。"), (("y", 1), "二句。")]
    assert got["x", 0].langs == got["x", 1].langs == {"cmn": "龍山寺在台北。很好！", "eng": "Longshan Temple.", "jpn": "龍山寺"} and got["y", 1].langs == {"cmn": "二句。"}
    assert [(got["x", i].start, got["x", i].end) for i in range(3)] == [(0, 7), (8, 11), (12, 15)]


def test_a_splitter_in_python_fits_everywhere(spark):
    split = lambda c: F.pandas_udf(lambda s: s.map(lambda t: t.split("|")), "array<string>")(c)
    rows = spark.createDataFrame([("x", "龍|山")], "id string, text string")
    assert [r.text for r in H.unit_atoms(rows, split=split).orderBy("pos").collect()] == [r.text for r in H.atoms(rows, "id", split(F.col("text"))).orderBy("pos").collect()] == ["龍", "山"]


def test_chunks_join_the_languages_of_their_atoms(spark):
    rows = [("x", i, f"s{i}", 3 * i, 3 * i + 2, {"cmn": f"s{i}", "eng": f"e{i}"} if i % 2 else {"cmn": f"s{i}", "jpn": "", "kor": "k"}) for i in range(4)]
    atoms = spark.createDataFrame(rows, "id string, pos int, text string, start int, end int, langs map<string,string>")
    out = sorted(H.offset_chunks(atoms, high=4, low=4).collect(), key=lambda r: r.chunk)
    assert [(r.core, r.langs, r.ref) for r in out] == [("s0\ns1\n", {"cmn": "s0 s1", "eng": "e1", "kor": "k"}, "k / e1"), ("s2\ns3", {"cmn": "s2 s3", "eng": "e3", "kor": "k"}, "k / e3")]
    whole = H.offset_chunks(H.unit_atoms(spark.createDataFrame([("u", "--- 1\nzh: 甲。乙。\nen: A\n--- 2\nzh: 丙。\nen: C\n")], "id string, text string"))).first()
    assert whole.core == "甲。\n乙。\n丙。" and whole.langs["eng"] == "A A C" and whole.ref == "A A C"


def test_packing_by_plain_folds(spark):
    r = random.Random(1)
    for _ in range(60):
        pieces = ["x" * r.randint(0, 9) for _ in range(r.randint(0, 15))]
        most, carried = r.randint(1, 20), r.randint(0, 3)
        chunks, cur = [], []
        for p in pieces:
            if cur and sum(map(len, cur)) + len(p) > most:
                chunks.append("".join(cur))
                cur = cur[len(cur) - carried :] if carried and carried < len(cur) else cur if carried else []
            cur = [*cur, p]
        bounds = H.packed(list(map(len, pieces)), most, carried)
        assert ["".join(pieces[a:b]) for a, b in bounds] == chunks + (["".join(cur)] if cur else [])
    assert len(H.packed([3] * 200_000, 400)) == -(-200_000 // 133)  # linear in the number of pieces
    rows = spark.createDataFrame([(1, "aa|bb|cc"), (None, "x"), (3, None)], "i long, text string")
    assert sorted(map(str, map(tuple, H.pack_overlap(rows, "i", F.split("text", "\\|"), 4).collect()))) == ["(1, 0, 'aabb')", "(1, 1, 'bbcc')", "(None, 0, 'x')"]


def test_variants_and_names_of_entities(spark):
    rows = spark.createDataFrame(
        [("b", 2, "f2", ["v1", "v3"], {"eng": "late", "jpn": "j"}, {"jpn": "text"}), ("b", 1, "f1", ["v2", "v1", ""], {"eng": "first", "fra": ""}, None), ("c", 3, "f1", None, None, None)],
        "term string, ord int, file string, variants array<string>, names map<string,string>, names_src map<string,string>",
    ).withColumns({"occ": F.lit(1), "gloss": F.lit(""), "category": F.lit(""), "reason": F.lit(""), "is_special": F.lit(None).cast("boolean")})
    got = {r.term: r for r in K.merge_fill_first(rows).collect()}
    assert (got["b"].variants, got["b"].names, got["b"].names_src, got["b"].occ, got["b"].files) == (["v2", "v1", "v3"], {"eng": "first", "jpn": "j"}, {"eng": "gen", "jpn": "text"}, 2, ["f1", "f2"])
    assert (got["c"].variants, got["c"].names) == ([], {})


def test_special_note_has_concepts_first(spark, tmp_path):
    terms = spark.createDataFrame([("a", "X", "B", True), ("b", "W", "A", True), ("c", "", "", True), ("d", "X", "B", False), ("a", "X", "B", True)], "term string, category string, reason string, is_special boolean")
    stores.write_note(K.special_notes(terms, "geo", "list of {}", "Concepts"), f"file://{tmp_path}/n")
    text = [r.value for r in spark.read.text(f"file://{tmp_path}/n").collect()]
    assert text == ["---", "domain: geo", "term_count: 4", "---", "", "# list of geo", "", "## Concepts", "a", "", "## W", "b", "", "## X", "a", "", "## 未分類", "c", ""]
    assert K.special_notes(terms.limit(0), "geo").count() == 7


def test_graph_counts_what_it_does_not_show(spark):
    notes = spark.createDataFrame([(f"n{i:02d}.md", f"t{i}", "xy"[i % 2], "llm:a" if i % 3 else "glossary:b", i / 10, [f"t{i + 2}", f"domains/{'xy'[i % 2]}"]) for i in range(10)], "name string, term string, category string, source string, confidence double, links array<string>")
    shown = G.filter_notes(notes, category="x", source="llm", least=0.3, contains="t", limit=2)
    assert [r.term for r in shown.collect()] == ["t4", "t8"]
    assert tuple(G.graph_stats(notes, shown, G.edges(shown)).first()) == (10, 2, 1)
    every = G.filter_notes(notes, limit=4)
    assert tuple(G.graph_stats(notes, every, G.edges(every)).first()) == (10, 4, 2)
    assert [(r.title, r.terms) for r in G.reverse_links(spark.createDataFrame([("b", "p", 1.0), ("a", "p", 0.5)], "term string, title string, score double")).collect()] == [("p", ["a", "b"])]
