"""Golden rows for operators that no query covers."""

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import phonetic as P
from lexiforge.functions import text as T
from lexiforge.functions.readings import Reader
from lexiforge.operators import candidates as C
from lexiforge.operators import cards as K
from lexiforge.operators import chunks as H
from lexiforge.operators import decide as D
from lexiforge.operators import dictionary as Y
from lexiforge.operators import entities as N
from lexiforge.operators import evidence as E
from lexiforge.operators import extraction as X
from lexiforge.operators import knowledge as B
from lexiforge.operators import newwords as W
from lexiforge.operators import wiki as I
from lexiforge.plans import flows
from lexiforge.sources import stores
from lexiforge.streaming import incremental as S


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    m = F.from_json(F.lit('{"en": "Longshan Temple", "中文": "龍山寺", "xx": "no", "ja": "これはとても長い名前なので使えませんよね"}'), "map<string,string>")
    assert one(spark, T.parse_names(m)) == ({"eng": "Longshan Temple", "cmn": "龍山寺"},)
    assert one(spark, T.extract_json(F.lit('say {"a": [1]} so')).cast("string"), T.extract_json(F.lit("none")), T.extract_json(F.lit("{bad")))[0] == '{"a":[1]}'
    simp, trad = {"龍": "龙", "臺": "台"}, {"龙": "龍"}
    assert one(spark, T.to_simp(F.lit("龍臺"), simp), T.to_trad(F.lit("龙x"), trad), T.to_tw(F.lit("龙软件"), {"龙": "龍", "软": "軟"}, {"軟件": "軟體"})) == ("龙台", "龍x", "龍軟體")
    table = T.fold_table(simp, trad)
    assert one(spark, T.flatten(F.lit("龍龙臺台"), table)) == ("龍龍台台",) and one(spark, T.same_flat(F.lit("龙"), F.lit("龍"), table)) == (True,)
    langs = F.from_json(F.lit('{"cmn": "甲", "eng": "a", "jpn": ""}'), "map<string,string>")
    assert one(spark, T.parallel_text(langs), T.parallel_text(langs, most=3)) == ("eng: a", "eng")


def test_decisions_and_patches(spark):
    o = spark.createDataFrame([("a", "extract"), ("b", "exclude")], "rel string, override string")
    assert rows(S.set_decisions(o, spark.createDataFrame([("a", "auto"), ("c", "exclude")], o.schema))) == [("b", "exclude"), ("c", "exclude")]
    listed = spark.createDataFrame([("z", "new"), ("b", "extracted"), ("a", "changed"), ("c", "new")], "rel string, status string")
    assert [r.rel for r in S.listed(listed).collect()] == ["c", "z", "a", "b"]
    spans = spark.createDataFrame([("s1", "g1", "human"), ("s2", "g1", "auto"), ("s3", "g2", "human")], "span_id string, seg_id string, decision string")
    assert rows(D.manual_queue(spans)) == [("s1",), ("s3",)]
    new = spark.createDataFrame([("n1", "g1", "pending")], spans.schema)
    assert rows(D.replace_segments(spans, new, new), "span_id", "decision") == [("n1", "pending"), ("s3", "human")]
    terms = spark.createDataFrame([("t1", "a", 0.5), ("t2", "b", 0.6)], "term_id string, correct string, confidence double")
    patch = spark.createDataFrame([("t1", None, 0.9)], "term_id string, correct string, confidence double")
    assert rows(Y.patch_terms(terms, patch)) == [("t1", "a", 0.9), ("t2", "b", 0.6)]


def test_entities(spark):
    e = spark.createDataFrame([("g", 0, "龍山寺", "FAC"), ("g", 9, "龍山寺", "FAC"), ("g", 4, "三點", "TIME"), ("g", 6, "x", "ORG"), ("g", 7, "台北", "GPE")], "seg_id string, start int, surface string, type string")
    assert rows(N.useful_entities(e), "start", "surface") == [(0, "龍山寺"), (7, "台北")]
    assert rows(N.useful_entities(e, e.filter("start = 7")), "surface") == [("龍山寺",)]
    assert rows(C.without_targets(N.useful_entities(e), spark.createDataFrame([("台北",)], "flat string")), "surface") == [("龍山寺",)]
    tags = [(1, 0, "B-LOC-x", 0, 1, 0.9), (1, 1, "E-LOC-x", 1, 3, 0.8), (1, 2, "O", 3, 4, 0.9), (1, 3, "S-ORG", 4, 5, 0.7), (1, 4, "S-ORG", 5, 6, 0.6)]
    got = N.decode_bioes(spark.createDataFrame(tags, "doc int, pos int, tag string, start int, end int, score double"), texts=spark.createDataFrame([(1, "龍山寺 x ")], "doc int, text string"))
    assert rows(got, "start", "end", "type", "score", "surface") == [(0, 3, "LOC-x", 0.8, "龍山寺"), (4, 5, "ORG", 0.7, "x")]


def test_evidence_lines(spark):
    e = spark.createDataFrame([("s", 2, "b", "ipa 0.5"), ("s", 1, "a", "variant 1.0")], "span_id string, rank int, candidate string, evidence string")
    assert rows(E.render_evidence(e)) == [("s", "a(variant 1.0) b(ipa 0.5)")]


def test_chunks_of_the_anchor_language(spark):
    t = spark.createDataFrame([("x", "zh: 龍山寺在台北。\nen: Longshan\n。。。\n海蝕。")], "id string, text string")
    assert rows(H.make_chunks(t, most=8), "chunk", "text", "bare")[0] == (0, "龍山寺在台北。", "龍山寺在台北")


def test_knowledge_overlays_and_edits(spark):
    schema = "flat string, term string, category string, gloss string, is_special boolean, reason string"
    first = spark.createDataFrame([("a", "a", "人名", "g", False, ""), ("b", "b", "", "", False, "")], schema)
    second = spark.createDataFrame([("a", "A", "地點地名", "h", True, "A"), ("c", "c", "人名", "", True, "B")], schema)
    assert rows(B.overlay_special(first, second)) == [("a", "a", "地點地名", "g", True, "A"), ("b", "b", "", None, False, None), ("c", "c", "人名", "", True, "B")]
    terms = spark.createDataFrame([("a", ["x"], False, True, "T1", "人物"), ("b", [], False, False, "T3", "什麼")], "term string, variants array<string>, locked boolean, is_special boolean, tier string, category string")
    edits = spark.createDataFrame([("a", ["y", "a", "y"])], "term string, variants array<string>")
    assert rows(B.set_variants(terms, edits), "term", "variants", "locked") == [("a", ["y"], True), ("b", [], False)]
    assert rows(flows.relabel(terms), "term", "category") == [("a", "人名"), ("b", "未分類")]
    assert rows(B.seed_rows(terms.withColumn("variants", F.array(F.lit(" v "), F.lit(" "))))) == [("a", ["v"], True, "T1"), ("b", ["v"], False, "T3")]
    assert [tuple(r) for r in B.special_list(terms).collect()] == [("a", 1), ("b", 0)] and rows(B.special_list(terms, special_only=True)) == [("a", 1)] and B.special_list(terms, "b").count() == 1
    assert rows(B.list_sizes(terms)) == [(2, 1, 1, 1)]
    assert rows(B.insert_absent(terms, terms.withColumn("tier", F.lit("new")), "term"), "term", "tier") == [("a", "T1"), ("b", "T3")]
    assert rows(B.upsert(terms, terms.filter("term = 'a'").withColumn("tier", F.lit("new")), "term"), "term", "tier") == [("a", "new"), ("b", "T3")] and rows(B.remove(terms, edits, "term"), "term") == [("b",)]
    relations = spark.createDataFrame([("a", "b", "d")], "source string, target string, descr string")
    renamed, moved = B.rename_term(terms, relations, "a", "z")
    assert rows(renamed, "term", "variants", "locked") == [("b", [], False), ("z", ["x", "a"], True)] and rows(moved) == [("z", "b", "d")]
    status = spark.createDataFrame([("f", True, []), ("f", True, []), ("g", False, ["note"]), ("h", False, []), ("i", True, []), ("i", False, [])], "file string, failed boolean, labels array<string>")
    assert rows(status.groupBy("file").agg(B.build_status(F.col("failed"), F.col("labels")).alias("s"))) == [("f", "failed"), ("g", "partial"), ("h", "complete"), ("i", "partial")]
    assert [r.term for r in B.known_terms(spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "term string, occ long"), 2).collect()] == ["b", "c"]


@pytest.fixture
def glossary(spark):
    return spark.createDataFrame([("g", "紅碁", "", 0.9, ["宏碁"], {"eng": "Hongqi"})], "flat string, term string, category string, confidence double, variants array<string>, names map<string,string>")


def test_build_with_a_tuner_and_locks(spark, glossary):
    docs = spark.createDataFrame([("甲", 1, 2, "f1", "gl", "人名", "", True), ("甲", 2, 1, "f2", "", "", "B", False)], "term string, ord int, occ int, file string, gloss string, category string, reason string, is_special boolean")
    none = spark.createDataFrame([], "ord int, source string, target string, descr string")
    tune = lambda t: t.withColumn("category", F.when(F.col("term") == "甲", "事件活動").otherwise(F.col("category")))
    terms, _ = flows.build_terms(docs, glossary.withColumn("flat", F.col("term")), none, tune=tune)
    assert rows(terms, "term", "tier", "category", "reason") == [("甲", "T2", "事件活動", "B"), ("紅碁", "T1", "未分類", "A")]
    old = spark.createDataFrame([("甲", "作品或標題", "old", True)], "term string, category string, gloss string, locked boolean")
    locked, _ = flows.build_terms(docs, glossary.withColumn("flat", F.col("term")), none, existing=old)
    assert rows(locked.filter("locked"), "term", "category", "gloss") == [("甲", "作品或標題", "old")]


def test_wiki(spark):
    e = spark.createDataFrame([("a", ["x", "y"], 1), ("b", [], 2)], "title string, aliases array<string>, pageid int")
    assert rows(I.entry_stats(e)) == [(2, 2)] and rows(I.to_index(e, e.filter("pageid = 1")), "title") == [("b",)]
    dump = lambda *f: spark.createDataFrame([(list(f),)], "fields array<string>")
    assert I.redirect_column(dump("1", "0", "t", "0", "0.5")) == 3 and I.redirect_column(dump("1", "0", "t", "", "1")) == 4 and I.redirect_column(dump("1")) == 3


def test_listed_terms_and_harvest(spark):
    lines = spark.createDataFrame([("# c",), (" 龍山寺 ",), ("",), ("龍山寺",)], "value string")
    assert rows(W.listed_terms(lines)) == [("龍山寺", "manual", 0.95)]
    ner = X.harvest_entities(spark.createDataFrame([(1, "台北", "GPE"), (2, "台北", "GPE"), (3, "三", "CARDINAL"), (4, " ", "ORG"), (5, "停用", "ORG")], "ord long, surface string, type string"), stop=("停用",))
    told = X.harvest_listed(spark.createDataFrame([("f", 'ok ["台北", "龍山寺", "不在", "x"]'), ("g", None)], "file string, raw string"), spark.createDataFrame([("f", "台北的龍山寺 x")], "file string, text string"))
    assert [tuple(r) for r in X.harvest(ner, told).collect()] == [("台北", "llm", 0.85), ("龍山寺", "llm", 0.85)]


def test_file_kinds(spark):
    f = spark.createDataFrame([("a/x.xlsx", False), ("b.docx", False), ("c.txt", False), ("c.txt", True), ("逐字稿.docx", False), ("逐字稿.docx", True), ("d", None), ("e.png", True)], "rel string, forced boolean")
    assert [r[0] for r in f.select(X.file_kind(F.col("rel"), F.col("forced"))).collect()] == ["glossary", "doc", "skip", "doc", "skip", "doc", "skip", "skip"]
    assert [r[0] for r in f.select(X.file_kind(F.col("rel"), F.col("forced"), with_model=False)).distinct().collect()].count("doc") == 0


def test_two_passes(spark):
    texts = spark.createDataFrame([("f", "龍山寺在台北，很有名")], "file string, text string")
    p1 = spark.createDataFrame(
        [
            ("f", 1, '{"entities": [{"term": "龍山寺", "type": "地點", "gloss": "廟", "names": {"en": "Longshan"}}, {"name": "不在", "type": "x"}, {"term": "123"}], "relationships": [{"source": "龍山寺", "target": "台北", "desc": "位於"}, {"source": "a", "target": "a"}]}', "stop"),
            ("f", 2, '{"term": "龍山寺", "gloss": "later"} {"term": "台北"}', "stop"),
            ("f", 3, '{"term": "有名"}', "length"),
        ],
        "file string, attempt int, raw string, finish string",
    )
    assert rows(X.first_pass(p1, texts), "term", "category", "gloss", "names", "names_src") == [("台北", "", "", {}, {}), ("龍山寺", "地點", "廟", {"eng": "Longshan"}, {"eng": "gen"})]
    assert rows(X.stated_relations(p1, texts), "source", "target", "descr") == [("龍山寺", "台北", "位於")]
    assert rows(X.pass_status(p1)) == [("f", "partial", ["length"])]
    p2 = spark.createDataFrame([("f", 1, '[{"term": "龍山寺", "reason": "a", "variants": ["龍山是", "龍山寺", "7"]}, {"term": "台北", "reason": "Z"}, {"term": "不在", "reason": "A"}]', "stop"), ("g", 1, "no json", "stop"), ("h", 1, None, None)], p1.schema)
    assert rows(X.second_pass(p2, texts), "term", "reason", "variants") == [("龍山寺", "A", ["龍山是"])]
    assert rows(X.pass_status(p2)) == [("f", "complete", []), ("g", "failed", ["parse_failed"]), ("h", "failed", ["no_answer"])]


def test_entities_of_a_glossary(spark, glossary):
    e = spark.createDataFrame([("宏碁", "宏碁"), ("正名", "正名"), ("台北", "台北")], "flat string, term string")
    assert rows(X.without_heard(e, glossary, stop=("正名",)), "term") == [("台北",)] and X.without_heard(e, glossary).count() == 2
    g = spark.createDataFrame([("f", 2, "乙", "", [], ""), ("f", 1, "甲", "人名", ["申"], "在此")], "file string, ord int, term string, category string, variants array<string>, context string")
    assert rows(X.glossary_block(g)) == [("f", "甲；人名；申；在此\n乙")]


def test_cards(spark):
    cards = spark.createDataFrame([(1, "龍山寺", [1.0], [(" 寺 ", ["t"], 0.6), ("", [], 0.9)]), (2, "龙山寺", None, []), (3, "台北", [0.5], None)], "ord int, term string, vec array<double>, wiki array<struct<title:string,aliases:array<string>,score:double>>")
    glyphs = {"龙": "龍"}
    words = spark.createDataFrame([("龙山寺",), ("無",)], "word string")
    assert {(r.word, r.card.vec[0] if r.card else None) for r in K.cards_of(words, cards, glyphs).collect()} == {("龙山寺", 1.0), ("無", None)}
    met = spark.createDataFrame([("q", 1, "龙山寺"), ("q", 2, "台北")], "query string, ord int, entity string")
    assert rows(K.stored_pages(met, cards, glyphs)) == [("q", 1, "龙山寺", "寺", ["t"], 0.6)]
    assert rows(K.to_link(cards), "term") == [("台北",)]
    t, g = spark.createDataFrame([(True,), (False,)], "is_cag boolean"), spark.createDataFrame([(True,), (False,), (False,)], "ambiguous boolean")
    assert rows(K.index_stats(t, g, cards)) == [(2, 1, 2, 1, 3, 2)]
    terms = spark.createDataFrame([("甲", ["申"]), ("申", []), ("乙", ["已"])], "term string, variants array<string>")
    assert rows(K.notes_of(terms, spark.createDataFrame([("申",), ("已",), ("無",)], "word string"))) == [("已", "乙"), ("申", "申")]


def test_stores(spark, tmp_path):
    path = f"file://{tmp_path}/dict"
    assert stores.load_version(spark, path, stores.TERMS).count() == 0
    terms = spark.createDataFrame([("t", "龙", ["x"], [], 1, 1, 0.6)], stores.TERMS)
    stores.save_terms(terms, path, lambda c: T.to_tw(c, {"龙": "龍"}, {}))
    stores.save_terms(stores.load_version(spark, path, stores.TERMS).withColumn("confidence", F.lit(0.7)), path)
    assert rows(stores.load_version(spark, path, stores.TERMS), "correct", "confidence") == [("龍", 0.7)]
    classes = stores.add_class(stores.add_class(spark.createDataFrame([], stores.CLASSES), "a", "p"), "b")
    cid = classes.filter("name = 'a'").first().class_id
    assert rows(stores.edit_class(classes, cid, prompt="q"), "name", "prompt") == [("a", "q"), ("b", "")] and rows(stores.remove_class(classes, cid), "name") == [("b",)]
    with pytest.raises(KeyError):
        stores.edit_class(classes, "none", name="x")
    stores.put_file(spark, f"file://{tmp_path}/in/a.txt", b"text")
    stores.move_file(spark, f"file://{tmp_path}/in/a.txt", f"file://{tmp_path}/old/a.txt")
    assert (tmp_path / "old" / "a.txt").read_bytes() == b"text" and stores.clear(spark, f"file://{tmp_path}/old", f"file://{tmp_path}/none") == 1
    with pytest.raises(ValueError):
        stores.put_file(spark, f"file://{tmp_path}/../x", b"")
    batches = spark.createDataFrame([("b1", 1), ("b2", 2)], "batch_id string, v int")
    assert rows(stores.without_batch(batches, "b1")) == [("b2", 2)]
    rules = spark.createDataFrame([("regex", "x", "y", "t")], "kind string, pattern string, replace string, term_id string")
    stores.write_export(rules, f"file://{tmp_path}/export")
    assert spark.read.json(f"file://{tmp_path}/export").select("kind", "pattern").first() == ("regex", "x")
    for _ in range(2):
        stores.append_events(spark.createDataFrame([("e",)], "event string"), f"file://{tmp_path}/audit")
    assert spark.read.parquet(f"file://{tmp_path}/audit").count() == 2
    stores.write_lists(spark.createDataFrame([("人名", "b"), ("人名", "a")], "category string, term string"), f"file://{tmp_path}/lists")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/lists").collect()] == ["a", "b"]


def test_spelled_words_meet_as_if_all_were_compared(spark):
    import random

    r = random.Random(3)
    base = ["".join(r.choice("abnlo") for _ in range(r.randint(1, 12))) for _ in range(25)]
    words = [(lambda w, i: w[:i] + r.choice(["", "a", "l", "ln"]) + w[i + r.randint(0, 1) :])(w, r.randrange(len(w))) for w in base * 8]
    targets = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(set(words[:60])))], "ord int, correct string").withColumn("flat", F.col("correct")).withColumn("is_cag", F.lit(True))
    surfaces = spark.createDataFrame([(w,) for w in words], "surface string")
    costs = P.Costs(candidates=1000)
    d = Reader(costs=costs).word_distance(F.col("surface"), F.col("correct"))
    every = surfaces.distinct().crossJoin(targets.select("correct")).filter("surface <> correct").withColumn("d", d).filter(F.col("d") <= costs.fuzzy)
    got = C.phonetic_join(surfaces, targets, costs)
    assert rows(got, "surface", "correct") == rows(every, "surface", "correct") and got.count() > 100
    pairs = spark.createDataFrame([(a, b) for a, b in zip(words, words[7:] + [""] * 7)], "a string, b string")
    assert all(abs(x - y) < 1e-12 for x, y in pairs.select(P.spelled_distance()(F.col("a"), F.col("b")), Reader().word_distance(F.col("a"), F.col("b"))).collect())
    mixed = spark.createDataFrame([("a龍b",)], "surface string")
    near = spark.createDataFrame([(1, "a龙b", "a龙b", True)], "ord int, correct string, flat string, is_cag boolean")
    assert C.phonetic_join(mixed, near, reader=Reader({"龍": "long2", "龙": "long2"})).first().d == 0
