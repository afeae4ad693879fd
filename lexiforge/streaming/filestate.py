"""Work on files by their state: one record for each file, kept by the stream itself.

Listings say what content a file has, results how its extraction ended.  The
record of a file has the content last asked for, how that ended, and how often
it was tried; from it follows which files are to be extracted now.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "rel string, hash string, status string, at timestamp"
STATE = "hash string, status string, attempts int, changed timestamp"
WORK = "rel string, hash string, attempt int, reason string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(record: tuple | None, hash_: str, status: str | None, at, attempts: int) -> tuple[tuple | None, tuple | None]:
    """(record, work) after one event of a file; ``status`` is null for a listing.

    New content is always asked for, content that a file had before its last one
    too.  The same content is asked for again when it is listed after a failed,
    partial or missing result, up to ``attempts`` times.  A result for other
    content than the last one asked for is out of date and changes nothing.
    """
    if status is not None:
        return ((hash_, status, record[2], record[3]) if record and record[0] == hash_ else record), None
    if record is None or record[0] != hash_:
        return (hash_, "pending", 1, at), (hash_, 1, "new" if record is None else "changed")
    if record[1] != "complete" and record[2] < attempts:
        return (hash_, "pending", record[2] + 1, record[3]), (hash_, record[2] + 1, record[1])
    return record, None


class FileRecords(StatefulProcessor):
    """Keeps the record of each file and hands out the work that follows from its events: results, then listings in order of time."""

    def __init__(self, attempts: int):
        self.attempts = attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        record = self.record.get() if self.record.exists() else None
        work = None
        # results are of work from earlier batches, so they come before the listings of this one
        for r in sorted(rows, key=lambda r: (r.status is None, r.at.timestamp() if r.at else 0.0, r.hash)):
            record, asked = decide(record, r.hash, r.status, r.at, self.attempts)
            work = asked or work
        if record is not None:
            self.record.update(tuple(record))
        # of several contents in one batch only the last one is there to be read
        if work and record[0] == work[0]:
            yield Row(rel=key[0], hash=work[0], attempt=work[1], reason=work[2])

    def close(self) -> None:
        pass


def work_of(events: DataFrame, attempts: int = 3) -> DataFrame:
    """rel, hash, attempt, reason of a stream of events (rel, hash, status, at): the files to be extracted now.

    Rows without a file or a content are left out.  The state holds one small
    record for each file, spread over the tasks by a hash of the name, and needs
    the RocksDB state store, which this sets for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    known = events.filter("rel is not null and hash is not null")
    return known.groupBy("rel").transformWithState(FileRecords(attempts), WORK, "Update", "None")


def follow_files(listings: DataFrame, results_path: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str, attempts: int = 3) -> StreamingQuery:
    """Extract files as their streaming listing (rel, hash, at) asks for, and take in how that ended.

    ``extract`` turns work (rel, hash, attempt, reason) into results (rel, hash,
    status), written under ``results_path``, one folder for each micro-batch,
    from where the next run of this query reads them.  If a batch fails on the way
    its work is handed out once more; its folder is replaced, so nothing counts twice.
    """
    spark = listings.sparkSession
    _ensure(spark, results_path)
    results = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(results_path)
    events = listings.select("rel", "hash", F.lit(None).cast("string").alias("status"), F.col("at").cast("timestamp").alias("at")).unionByName(results)

    def step(batch: DataFrame, number: int) -> None:
        done = extract(batch).select("rel", "hash", F.col("status").cast("string").alias("status"), F.current_timestamp().alias("at"))
        done.write.mode("overwrite").parquet(f"{results_path}/batch={number}")

    return work_of(events, attempts).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ensure(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
