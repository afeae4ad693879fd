"""Incremental processing keyed by content, as batch joins and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiforge.functions.text import auto_decision


def newest(manifest: DataFrame) -> DataFrame:
    """rel, hash, build_status: the last record of each file, by ``at`` where the manifest has it, else its only one."""
    if "at" not in manifest.columns:
        return manifest.select("rel", "hash", "build_status")
    last = manifest.groupBy("rel").agg(F.max_by(F.struct("hash", "build_status"), F.struct("at", "hash", "build_status")).alias("last"))
    return last.select("rel", "last.hash", "last.build_status")


def source_status(files: DataFrame, manifest: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """rel, status, decision of files (rel, hash, archived) against the manifest (rel, hash, build_status, perhaps at)."""
    m = newest(manifest).select("rel", F.col("hash").alias("old"), "build_status")
    f = files.join(m, "rel", "left")
    f = f.join(overrides.select("rel", "override"), "rel", "left") if overrides is not None else f.withColumn("override", F.lit(None).cast("string"))
    decision = F.when(F.col("archived"), "exclude").otherwise(F.coalesce("override", auto_decision(F.col("rel"))))
    same = F.col("old") == F.col("hash")
    status = F.when(decision == "exclude", "skip").when(same & F.col("build_status").isin("partial", "failed"), F.col("build_status")).when(same, "extracted").when(F.col("old").isNotNull(), "changed").otherwise("new")
    return f.select("rel", status.alias("status"), decision.alias("decision"))


def listed(status: DataFrame) -> DataFrame:
    """Sources for a list: new ones, changed ones, then the others, each by path."""
    return status.orderBy(F.col("status") != "new", F.col("status") != "changed", "rel")


def set_decisions(overrides: DataFrame, changes: DataFrame) -> DataFrame:
    """Overrides with changes (rel, override) put in; auto takes one out."""
    kept = overrides.join(changes.select("rel"), "rel", "left_anti")
    return kept.unionByName(changes.filter(F.col("override").isin("extract", "exclude")))


def to_extract(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose last record isn't a complete one of the same content: new, changed, partial and failed ones."""
    done = newest(manifest).filter("build_status = 'complete'").select("rel", "hash")
    return files.join(done, ["rel", "hash"], "left_anti")


def reuse_cards(nodes: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with the vector of a card of the same hash, nodes to embed)."""
    have = cards.filter("vec is not null").select("term", "hash", "vec")
    return nodes.join(have, ["term", "hash"]), nodes.join(have, ["term", "hash"], "left_anti")


def stream_new(files: DataFrame, manifest_path: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Run ``extract`` on new or changed files of a streaming listing and append to the manifest table.

    Each micro-batch is joined to the manifest as it then stands, so a file
    seen again with the same content costs nothing; records are ordered by the
    number of their batch, so a file that goes back to older content is done again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            manifest = spark.read.parquet(manifest_path)
        except Exception as e:  # no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            manifest = spark.createDataFrame([], "rel string, hash string, build_status string, at long")
        done = extract(to_extract(batch.dropDuplicates(["rel", "hash"]), manifest)).select("rel", "hash", "build_status")
        done.withColumn("at", F.lit(number).cast("long")).write.mode("append").parquet(manifest_path)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_commits(events: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Evidence by time window over a stream or table of (ts, event_type, user_id): distinct users, late rows bounded."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
