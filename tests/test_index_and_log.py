"""The commit log of tables and the vector index kept in one."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import evidence as E
from lexiforge.operators.vector_index import VectorIndex
from lexiforge.sources.tablelog import SNAPSHOT, Conflict, Exists, TableLog


@pytest.fixture
def log(spark, tmp_path):
    return TableLog(spark, f"file://{tmp_path}/t", "id int, v string")


def held(log, version=None):
    return sorted((r.id, r.v) for r in log.read(version).collect())


def rows(log, *pairs):
    return log.spark.createDataFrame(list(pairs), log.schema)


def test_versions_are_whole_and_stay(log):
    assert log.latest() == -1 and held(log) == [] and log.history().count() == 0
    assert log.append(rows(log, (1, "a"), (2, "b"))) == 0
    log.upsert(rows(log, (2, "B"), (3, "c"), (3, "d")), ["id"])
    log.delete(rows(log, (1, "")), ["id"])
    assert held(log) == [(2, "B"), (3, "c"), (3, "d")] and held(log, 0) == [(1, "a"), (2, "b")] and held(log, 1) == [(1, "a"), (2, "B"), (3, "c"), (3, "d")]
    assert log.undo() == 3 and held(log) == held(log, 1)
    log.restore(0)
    assert held(log) == held(log, 0)
    log.update(lambda t: t.withColumn("v", F.upper("v")))
    assert held(log) == [(1, "A"), (2, "B")]
    assert [r.operation for r in log.history().orderBy("version").collect()] == ["append", "upsert", "delete", "restore 1", "restore 0", "update"]
    with pytest.raises(KeyError):
        log.read(17)


def test_only_folders_with_the_keys_are_written_anew(log):
    for i in range(4):
        log.append(rows(log, (i, "x"), (10 + i, "y")))
    before = log.parts()
    log.upsert(rows(log, (2, "new")), ["id"])
    assert [p for p in before if p not in log.parts()] == [before[2]]
    log.delete(rows(log, (99, "")), ["id"])
    assert len(held(log)) == 8 and (2, "new") in held(log) and (2, "x") not in held(log)


def test_insert_of_keys_that_are_there(log):
    log.insert(rows(log, (1, "a")), ["id"])
    with pytest.raises(Exists, match="1"):
        log.insert(rows(log, (1, "b"), (2, "c")), ["id"])
    with pytest.raises(Exists):
        log.insert(rows(log, (5, "b"), (5, "c")), ["id"])
    assert held(log) == [(1, "a")] and log.latest() == 0


def test_snapshots_shorten_the_replay(log):
    for i in range(SNAPSHOT + 3):
        log.append(rows(log, (i, "x")))
    assert len(held(log)) == SNAPSHOT + 3 and "all" in log.entry(SNAPSHOT) and held(log, SNAPSHOT - 1) == [(i, "x") for i in range(SNAPSHOT)]


def test_two_writers_lose_nothing(log):
    """Both read the same version; the slower one starts again from what the faster one left."""
    log.append(rows(log, (0, "0")))
    gate, seen = threading.Barrier(2), []

    def add(n):
        first = [True]

        def change(t):
            seen.append(n)
            if first:
                first.clear()
                gate.wait(60)
            return t.unionByName(rows(log, (n, str(n))))

        TableLog(log.spark, log.path, log.schema).update(change)

    both = [threading.Thread(target=add, args=(n,)) for n in (1, 2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert held(log) == [(0, "0"), (1, "1"), (2, "2")] and log.latest() == 2 and len(seen) == 3


def test_stale_writer_gets_an_error(log):
    log.append(rows(log, (0, "0")))
    seen = log.latest()
    log.append(rows(log, (1, "1")))
    with pytest.raises(Conflict):
        log.replace(rows(log, (9, "9")), seen)
    assert held(log) == [(0, "0"), (1, "1")]
    assert log.replace(rows(log, (9, "9")), log.latest()) == 2 and held(log) == [(9, "9")]

    def always_late(t):
        log.append(rows(log, (2, "2")))
        return t

    with pytest.raises(Conflict):
        log.update(always_late, attempts=3)
    assert len(held(log)) == 4


def test_many_appends_at_once(log):
    errors = []

    def add(n):
        try:
            TableLog(log.spark, log.path, log.schema).append(rows(log, (n, "x")))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=add, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and [i for i, _ in held(log)] == list(range(6)) and log.latest() == 5


# ---- vector index


def vectors(spark, sf="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_rows_read(spark, tmp_path, sf):
    v = vectors(spark, sf)
    q, n = v.filter("id % 100 = 0"), v.count()
    index = VectorIndex(spark, f"file://{tmp_path}/ix").build(v)
    exact = {(r.query, r.card) for r in E.knn(q, v, 6).collect() if r.query != r.card}
    near = {(r.query, r.card) for r in index.search(q, 6).collect() if r.query != r.card}
    assert len(exact & near) >= 0.95 * len(exact)
    read = index.candidates(q, index.rerank(6))
    assert read.count() == q.count() * index.rerank(6)
    assert read.select("id").distinct().count() < 0.1 * n  # whole vectors read, for all queries together
    code = index.rows.read().first().code
    assert len(code) * 8 == 64 * 4


def test_appended_rows_are_found_without_a_rebuild(spark, tmp_path):
    v = vectors(spark)
    index = VectorIndex(spark, f"file://{tmp_path}/ix").build(v.filter("id % 3 > 0"))
    before, model = index.rows.parts(), index.models.latest()
    assert index.append(v.filter("id % 3 = 0 or id < 50")) == v.filter("id % 3 = 0").count()
    assert index.append(v) == 0
    assert index.models.latest() == model and set(before) <= set(index.rows.parts()) and index.rows.read().count() == v.count()
    own = index.search(v.filter("id % 30 = 0"), 1).collect()
    assert len(own) == v.filter("id % 30 = 0").count() and all(r.query == r.card for r in own)


def test_dealt_out_queries_find_the_same(spark, tmp_path):
    v = vectors(spark).filter("id < 120")
    index = VectorIndex(spark, f"file://{tmp_path}/ix").build(v, width=5)  # the last piece is shorter
    few, dealt = (sorted((r.query, r.id, round(r.approx, 9)) for r in index.candidates(v, 7, **o).collect()) for o in ({}, {"block": 50, "pack": 40}))
    assert few == dealt and len(few) == 7 * 120


def test_odd_vectors_in_the_index(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"k{i}", [float(x) for x in rng.normal(size=3)]) for i in range(30)] + [("zero", [0.0] * 3), ("k1", [9.0, 9.0, 9.0]), ("null", None), (None, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "id string, vec array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/ix", "string").build(v)
    assert index.rows.read().count() == 31
    assert index.search(v.filter("id = 'k3'"), 1).first().card == "k3" and index.search(v.limit(0), 3).count() == 0
    assert {r.score for r in index.search(v.filter("id = 'zero'"), 40).collect()} == {0.0}
    with pytest.raises(ValueError):
        VectorIndex(spark, f"file://{tmp_path}/none", "string").build(v.limit(0))
    with pytest.raises(KeyError):
        VectorIndex(spark, f"file://{tmp_path}/none", "string").centres
