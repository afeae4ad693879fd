"""Tables kept between runs: batches, dictionary, manifest and exports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.sources.tablelog import TableLog

BATCH_ID = r"[A-Za-z0-9._-]{1,80}"


def check_batch_id(batch_id: str) -> str:
    if not re.fullmatch(BATCH_ID, batch_id or ""):
        raise ValueError(f"not a batch id: {batch_id!r}")
    return batch_id


def read_batch(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    """The rows of one batch, from its own partition."""
    return spark.read.parquet(path).where(F.col("batch_id") == check_batch_id(batch_id))


def list_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("batch_id").distinct().orderBy("batch_id")


def write_batches(rows: DataFrame, path: str) -> None:
    """Replace the batches that ``rows`` holds and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def without_batch(rows: DataFrame, batch_id: str) -> DataFrame:
    return rows.where(F.col("batch_id") != check_batch_id(batch_id))


def write_export(rules: DataFrame, path: str) -> None:
    """Rules as JSON lines, by kind."""
    rules.write.mode("overwrite").partitionBy("kind").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Audit events: appended, never changed."""
    events.write.mode("append").parquet(path)


def write_lists(terms: DataFrame, path: str) -> None:
    """A text file of terms by category."""
    terms.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("term")), "\n").alias("value")).write.mode("overwrite").partitionBy("category").text(path)


def write_note(lines: DataFrame, path: str) -> None:
    """Lines (place, line) as one text file in order; a note of sections, not of rows, so it is small."""
    lines.orderBy("place").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_version(rows: DataFrame, path: str, seen: int | None = None) -> int:
    """Write a whole table as its new version; readers see it once it is complete.

    With ``seen``, the version that ``rows`` was made from, a commit by another
    writer since then is a ``Conflict`` instead of being overwritten.
    """
    return TableLog(rows.sparkSession, path, rows.schema).replace(rows, seen)


def load_version(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """A version of a table, by default the newest one, empty if there is none."""
    return TableLog(spark, path, schema).read(version)


def create_batch(log: TableLog, rows: DataFrame, key: str = "batch_id") -> int:
    """Add the rows of new batches; an id that is there already is an error."""
    for r in rows.select(key).distinct().limit(1000).collect():
        check_batch_id(r[key])
    return log.insert_keys(rows, [key])


def require(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The rows with a key; none is an error."""
    found = rows.filter(F.col(key) == value)
    if found.isEmpty():
        raise KeyError(f"{key} {value!r} is not there")
    return found


def attach(log: TableLog, batch_id: str, material: dict[str, str], column: str = "materials") -> int:
    """Append a material to a batch's list; an unknown batch is an error.  Others may attach at the same time."""

    def change(rows: DataFrame) -> DataFrame:
        require(rows, "batch_id", batch_id)
        new = F.create_map(*[F.lit(x) for kv in material.items() for x in kv])
        more = F.concat(F.coalesce(F.col(column), F.array().cast("array<map<string,string>>")), F.array(new))
        return rows.withColumn(column, F.when(F.col("batch_id") == batch_id, more).otherwise(F.col(column)))

    return log.update(change)


AUDIT = "at timestamp, stage string, source string, attempt int, kind string, in_hash string, out_hash string, preview string"


def audit_events(rows: DataFrame, stage: str, kind: str, source: str = "source", attempt: str = "attempt", given: str = "given", got: str = "got", preview: int = 240) -> DataFrame:
    """One event for each row: what went in and came out by hash, and the beginning of the answer on one line."""
    short = lambda c: F.when(F.col(c).isNotNull(), F.substring(F.sha2(F.col(c), 256), 1, 16))
    line = F.substring(F.regexp_replace(F.coalesce(F.col(got), F.lit("")), "\\s+", " "), 1, preview)
    return rows.select(F.current_timestamp().alias("at"), F.lit(stage).alias("stage"), F.col(source).cast("string").alias("source"), F.col(attempt).cast("int").alias("attempt"), F.lit(kind).alias("kind"), short(given).alias("in_hash"), short(got).alias("out_hash"), line.alias("preview"))


def latest_events(log: TableLog, by: list[str]) -> DataFrame:
    """The last event of each group of an audit log."""
    events = log.read()
    return events.groupBy(*by).agg(F.max_by(F.struct(*[c for c in events.columns if c not in by]), "at").alias("last")).select(*by, "last.*")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


TERMS = "term_id string, correct string, variants array<string>, domains array<string>, n_occurrences long, n_batches long, confidence double"
CLASSES = "class_id string, name string, prompt string"


def save_terms(terms: DataFrame, path: str, convert: Callable[[Column], Column] | None = None, seen: int | None = None) -> int:
    """The dictionary as a new version; ``convert`` may bring correct forms to one script and vocabulary."""
    return save_version(terms.withColumn("correct", convert(F.col("correct"))) if convert else terms, path, seen)


def add_class(classes: DataFrame, name: str, prompt: str = "") -> DataFrame:
    """``classes`` and a new one with an id of its own."""
    row = (f"cls_{uuid.uuid4().hex[:8]}", name, prompt)
    return classes.unionByName(classes.sparkSession.createDataFrame([row], CLASSES))


def edit_class(classes: DataFrame, class_id: str, name: str | None = None, prompt: str | None = None) -> DataFrame:
    """``classes`` with the given fields of one replaced; an unknown id is an error."""
    here = F.col("class_id") == class_id
    if classes.filter(here).isEmpty():
        raise KeyError(class_id)
    new = {c: F.when(here, F.lit(v)).otherwise(F.col(c)) for c, v in (("name", name), ("prompt", prompt)) if v is not None}
    return classes.withColumns(new)


def remove_class(classes: DataFrame, class_id: str) -> DataFrame:
    return classes.filter(F.col("class_id") != class_id)


def put_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write an uploaded source; its name may not lead out of the folder."""
    if ".." in path.split("/"):
        raise ValueError(path)
    p, fs = _files(spark, path)
    out = fs.create(p, True)
    out.write(data)
    out.close()


def move_file(spark: SparkSession, path: str, to: str) -> None:
    """Move a source, for instance to the archive; what lies there already stays and the move fails."""
    (a, fs), (b, _) = _files(spark, path), _files(spark, to)
    if not fs.exists(a) or fs.exists(b):
        raise FileNotFoundError(path) if not fs.exists(a) else FileExistsError(to)
    fs.mkdirs(b.getParent())
    fs.rename(a, b)


def clear(spark: SparkSession, *paths: str) -> int:
    """Remove outputs; how many were there."""
    return sum(fs.delete(p, True) for p, fs in (_files(spark, x) for x in paths) if fs.exists(p))
