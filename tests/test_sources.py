import gzip
import zipfile

from pyspark.sql import functions as F

from lexiforge.operators import candidates as C
from lexiforge.operators import dictionary as Y
from lexiforge.operators import evidence as E
from lexiforge.plans import catalogue
from lexiforge.plans.knowledge_queries import SHEETS, workbook
from lexiforge.sources import office, readers, stores
from lexiforge.streaming import incremental as S


def test_office_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> line</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        for n, t in ((10, "ten"), (2, "two")):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p>')
    (tmp_path / "c.xlsx").write_bytes(workbook(SHEETS))
    assert office.read_documents(spark, str(tmp_path), ".docx").first().text == "one line\ntwo"
    assert office.read_documents(spark, str(tmp_path), ".pptx").first().text == "two\nten"
    terms = {r.term: r for r in office.glossary_terms(office.read_sheets(spark, str(tmp_path))).collect()}
    assert set(terms) == {"生痕化石", "龍山寺", "台北", "紅碁石"}
    assert terms["生痕化石"].variants == ["深恆化石", "生核化石", "生痕花石"]
    assert (terms["生痕化石"].confidence, terms["生痕化石"].category, terms["生痕化石"].context) == (0.9, "術語", "展覽")
    assert terms["龍山寺"].names == {"eng": "Longshan Temple", "jpn": "龍山寺"}


def test_dump(spark, tmp_path):
    line = "INSERT INTO `page` VALUES (1,0,'Taipei_101',0,'x'),(2,0,'O\\'Hare (a, b)',1,NULL),(3,4,'',0,0.5);\n"
    with gzip.open(tmp_path / "d.sql.gz", "wt") as f:
        f.write("-- head\n" + line)
    rows = [r.fields for r in office.read_dump(spark, str(tmp_path / "d.sql.gz"), 2).orderBy("line", "pos").collect()]
    assert rows == [["1", "0", "Taipei_101", "0", "x"], ["2", "0", "O'Hare (a, b)", "1", "NULL"], ["3", "4", "", "0", "0.5"]]


def test_dump_fields():
    head = "INSERT INTO `t` VALUES "
    assert office.tuples(head + "(1,''),(2,'it''s'),(3,NULL,''),('(a),b'' ', 4)") == [["1", ""], ["2", "its"], ["3", "NULL", ""], ["(a),b ", " 4"]]
    assert office.tuples(head + r"('a\\b\'c\n',(x),1),('open") == [["a\\b'cn", "", "1"]]
    assert office.tuples("-- (1)") == [] and office.tuples(head) == []


def test_json_objects():
    assert office.json_objects('} {"a": 1} {"b": 2}') == [] and office.json_objects('{"a": {"b": 1} {') == []
    assert office.json_objects('a {"terms": [{"t": 1}], "relationships": [{"s": 2}]} {"x": {"y": 1}} {bad}') == ['{"t": 1}', '{"s": 2}', '{"x": {"y": 1}}']
    assert office.json_objects(None) == []


def test_notes_round_trip(spark, tmp_path):
    terms = spark.createDataFrame(
        [("龍山寺", "cmn-Hant", "", "地點地名", "glossary:t", "T1", 0.9, "A", True, False, {"eng": "Longshan"}, {"eng": "text"}, ["龍山是", "隆山寺"], "廟", "在龍山寺", ["農山寺"], [("台北", "位於")])],
        "term string, term_lang string, ipa string, category string, source string, tier string, confidence double, reason string, is_special boolean, locked boolean, names map<string,string>, names_src map<string,string>, variants array<string>, gloss string, context string, homophones array<string>, relations array<struct<target:string,descr:string>>",
    )
    r = readers.parse_notes(readers.render_notes(terms)).first()
    assert (r.term, r.category, r.confidence, r.is_special, r.locked, r.gloss, r.context) == ("龍山寺", "地點地名", 0.9, True, False, "廟", "在龍山寺")
    assert r.variants == ["龍山是", "隆山寺"] and r.names == {"eng": "Longshan"} and [tuple(x) for x in r.relations] == [("台北", "位於")]
    assert "domains/地點地名" in r.links


def test_text_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello\n\n2\n")
    (tmp_path / "t" / "b.txt").write_text("plain\n")
    got = {r.file.rsplit("/", 1)[1]: r.text for r in readers.read_texts(spark, str(tmp_path / "t")).collect()}
    assert got == {"a.srt": "hello", "b.txt": "plain\n"}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.txt").write_text("# no\nalpha\n beta \n\n")
    (tmp_path / "r" / "b.json").write_text('{"terms": ["gamma", {"term": "delta"}, {"correct": "eps"}]}')
    (tmp_path / "r" / "c.json").write_text("broken {")
    assert sorted(r.term for r in readers.read_term_lists(spark, str(tmp_path / "r")).collect()) == ["alpha", "beta", "delta", "eps", "gamma"]
    (tmp_path / "s.json").write_text('{"count": 2, "terms": [{"correct": "a", "variants": [" x ", ""], "is_special": true}, {"correct": "b", "variants": [], "is_special": false}]}')
    assert [tuple(r) for r in readers.read_seed(spark, str(tmp_path / "s.json")).collect()] == [("a", ["x"])]


def test_listing(spark, tmp_path):
    for rel in ("a.docx", "_excluded/b.docx", "_private/c.docx", ".git/d", "sub/e.txt", "package/f.txt", "sub/.gitkeep"):
        (tmp_path / rel).parent.mkdir(exist_ok=True)
        (tmp_path / rel).write_text("x")
    assert {(r.rel, r.archived) for r in readers.listed_sources(spark, str(tmp_path)).collect()} == {("a.docx", False), ("_excluded/b.docx", True), ("sub/e.txt", False)}


def test_batches(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "batch_id string, n int")
    stores.write_batches(rows, str(tmp_path / "b"))
    stores.write_batches(spark.createDataFrame([("b", 3), ("c", 4)], "batch_id string, n int"), str(tmp_path / "b"))
    assert [r.batch_id for r in stores.list_batches(spark, str(tmp_path / "b")).collect()] == ["a", "b", "c"]
    assert stores.read_batch(spark, str(tmp_path / "b"), "b").first().n == 3


def test_stream_takes_each_file_once(spark, tmp_path):
    files, manifest = str(tmp_path / "in"), str(tmp_path / "manifest")
    seen = []

    def extract(batch):
        seen.extend(r.rel for r in batch.collect())
        return batch.withColumn("build_status", F.lit("complete"))

    for k, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")])):
        spark.createDataFrame(rows, "rel string, hash string").write.mode("append").parquet(files)
        S.stream_new(spark.readStream.schema("rel string, hash string").parquet(files), manifest, extract, str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a", "b", "b"]


def test_snapshots_and_commit(spark):
    stack = spark.createDataFrame([("b", i, str(i)) for i in range(1, 11)], "batch_id string, seq long, spans string")
    pushed = Y.push_snapshot(stack, spark.createDataFrame([("b", "now")], "batch_id string, spans string"))
    assert pushed.count() == 10 and pushed.agg(F.min("seq")).first()[0] == 2
    restored, rest = Y.pop_snapshot(pushed)
    assert restored.first().spans == "now" and rest.count() == 9
    spans = spark.createDataFrame([("b1", "d", "right", "wrong", "c", "auto"), ("b1", "d", "right", "wrong", "c2", "auto"), ("b2", "d", "right", "wrong", "c", "human")], "batch_id string, domain string, correct string, wrong string, context string, decision string")
    common = spark.createDataFrame([], "word string")
    once, twice = Y.commit(Y.occurrences(spans), common).first(), Y.commit(Y.merge_occurrences(Y.occurrences(spans), Y.occurrences(spans)), common).first()
    assert once == twice and once.confidence == 0.6 and once.n_occurrences == 2


def test_approximate_neighbours_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.filter("id % 100 = 0")
    exact, near = E.knn(q, v, 5), E.knn_approximate(q, v, 5)
    hits = exact.select("query", "card").intersect(near.select("query", "card")).count()
    assert hits >= 0.9 * exact.count()


def test_registered_neighbours_recall(spark):
    for sf in ("sf0.01", "sf0.1"):
        exact, near = (catalogue.QUERIES[n](spark, f"/root/testdata/{sf}").select("query", "card").collect() for n in ("knn_exact", "knn_approximate"))
        assert len(set(exact) & set(near)) >= 0.95 * len(exact) and all(r.query != r.card for r in near)


def test_all_neighbours_without_k(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "id long, vec array<double>")
    assert E.knn(v.filter("id < 2"), v, None).count() == 40 and E.knn(v.filter("id < 2"), v, 3).count() == 6


def test_neighbours_in_blocks_and_edges(spark):
    rows = [(i, [float((i * 7) % 5 - 2), float(i % 3 - 1)]) for i in range(60)]  # with ties and zero vectors
    v = spark.createDataFrame(rows, "id long, vec array<double>").repartition(5)
    whole = sorted(map(tuple, E.knn(v, v, 4).collect()))
    assert sorted(map(tuple, E.knn(v, v, 4, block=7, pack=16).collect())) == whole and len(whole) == 240
    assert sorted(map(tuple, E.knn_approximate(v, v, 4, rerank=60).collect())) == whole
    none = v.limit(0)
    assert E.knn(none, v, 4).count() == E.knn(v, none, 4).count() == E.knn_approximate(v, none, 4).count() == E.knn_approximate(none, v, 4).count() == 0


def test_variant_scan_across_blocks(spark):
    text = "ab" * 700 + "é龍xab😀ab"
    t = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    long = text[200:500]
    v = spark.createDataFrame([(w, "c") for w in ("aba", "b", "龍xab", "😀a", long)], "variant string, correct string")
    got = sorted((r.start, r.surface) for r in C.variant_scan(t, v).collect())
    assert got == sorted((i, w) for w in ("aba", "b", "龍xab", "😀a", long) for i in range(len(text)) if text.startswith(w, i))


def test_tables_written_on_the_way_are_removed(spark):
    import glob

    from lexiforge import written

    folder = written.shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/cut-*"))
    out = written.staged(lambda: written.cut(written.cut(spark.range(5)).filter("id > 1")))
    assert sorted(r.id for r in out.collect()) == [2, 3, 4] and len(set(glob.glob(f"{folder}/cut-*")) - before) == 1
