"""The state of files: content that comes back, failures, and restarts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lexiforge.streaming import filestate as S
from lexiforge.streaming import incremental as I

T0 = dt.datetime(2024, 1, 1)


def test_decisions_of_one_file():
    steps, record, work = [("A", None), ("A", "complete"), ("A", None), ("B", None), ("A", "failed"), ("B", "failed"), ("B", None), ("B", "partial"), ("B", None), ("B", None), ("A", None), ("A", None)], None, []
    for hash_, status in steps:
        record, asked = S.decide(record, hash_, status, T0, 3)
        work.append(asked)
    assert work == [("A", 1, "new"), None, None, ("B", 1, "changed"), None, None, ("B", 2, "failed"), None, ("B", 3, "partial"), None, ("A", 1, "changed"), ("A", 2, "pending")]
    assert record == ("A", "pending", 2, T0)


class Watched:
    """A folder of listings, and an extraction that notes what it was asked for."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n, self.asked, self.fails = spark, path, 0, [], set()
        (path / "in").mkdir()

    def list(self, *files):
        self.n += 1
        rows = [json.dumps({"rel": r, "hash": h, "at": (T0 + dt.timedelta(minutes=self.n)).isoformat()}) for r, h in files]
        (self.path / "in" / f"{self.n}.json").write_text("\n".join(rows))

    def extract(self, work):
        rows = sorted((r.rel, r.hash, r.attempt) for r in work.collect())
        self.asked += rows
        if "crash" in self.fails:
            self.fails.remove("crash")
            raise RuntimeError("lost on the way")
        bad = list(self.fails)
        return work.withColumn("status", F.when(F.col("rel").isin(bad), "failed").otherwise("complete") if bad else F.lit("complete"))

    def run(self):
        listings = self.spark.readStream.schema("rel string, hash string, at timestamp").json(f"file://{self.path}/in")
        q = S.follow_files(listings, f"file://{self.path}/results", self.extract, f"file://{self.path}/checkpoint")
        q.awaitTermination(120)
        return q

    def go(self, *files):
        """List, run, and run again so that the results are taken in; what was asked for."""
        self.list(*files)
        before = len(self.asked)
        self.run()
        self.run()
        return self.asked[before:]


@pytest.fixture
def watched(spark, tmp_path):
    return Watched(spark, tmp_path)


def test_content_that_comes_back_is_done_again(watched):
    assert watched.go(("f", "A"), ("g", "X")) == [("f", "A", 1), ("g", "X", 1)]
    assert watched.go(("f", "A"), ("g", "X")) == []
    assert watched.go(("f", "B")) == [("f", "B", 1)]
    assert watched.go(("f", "A"), ("g", "X")) == [("f", "A", 1)]  # A, B, A: three times


def test_failures_are_tried_again_up_to_a_limit(watched):
    watched.fails.add("f")
    assert [watched.go(("f", "A"), ("g", "X")) for _ in range(4)] == [[("f", "A", 1), ("g", "X", 1)], [("f", "A", 2)], [("f", "A", 3)], []]
    watched.fails.clear()
    assert watched.go(("f", "C")) == [("f", "C", 1)]


def test_a_crash_on_the_way_loses_nothing(watched):
    watched.go(("f", "A"))
    watched.fails.add("crash")
    watched.list(("f", "B"), ("h", "Y"), (None, "Z"), ("i", None))
    with pytest.raises(Exception, match="lost on the way"):
        watched.run()
    watched.run()
    assert watched.asked[1:] == [("f", "B", 1), ("h", "Y", 1)] * 2  # handed out once more after the restart
    assert watched.go(("f", "B"), ("h", "Y")) == []


def test_manifest_counts_the_last_record_of_a_file(spark, tmp_path):
    records = spark.createDataFrame([("f", "A", "complete", 1), ("f", "B", "complete", 2), ("g", "X", "failed", 1), ("g", "X", "complete", 2)], "rel string, hash string, build_status string, at long")
    files = spark.createDataFrame([("f", "A", False), ("g", "X", False)], "rel string, hash string, archived boolean")
    assert [r.rel for r in I.to_extract(files, records).collect()] == ["f"]
    status = I.source_status(files.withColumn("rel", F.concat("rel", F.lit(".pdf"))), records.withColumn("rel", F.concat("rel", F.lit(".pdf"))))
    assert sorted((r.rel, r.status) for r in status.collect()) == [("f.pdf", "changed"), ("g.pdf", "extracted")]


def test_stream_with_a_manifest_does_content_again(spark, tmp_path):
    asked = []
    (tmp_path / "in").mkdir()

    def extract(files):
        asked.extend(sorted((r.rel, r.hash) for r in files.collect()))
        return files.withColumn("build_status", F.lit("complete"))

    for n, h in enumerate("ABAA"):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"rel": "f", "hash": h}))
        files = spark.readStream.schema("rel string, hash string").json(f"file://{tmp_path}/in")
        I.stream_new(files, f"file://{tmp_path}/manifest", extract, f"file://{tmp_path}/checkpoint").awaitTermination(120)
    assert asked == [("f", "A"), ("f", "B"), ("f", "A")]
