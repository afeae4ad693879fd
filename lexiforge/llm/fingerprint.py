"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes sets the boundaries of chunks, so an
edit moves only the boundaries near it.  Each chunk gives one character of a
signature; the block size that sets how rare boundaries are follows from the
length of the text.  A fingerprint is ``block:signature:signature at twice the
block``, and two are compared by edit distance at a block size they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, columns_of, cut, pieces

WINDOW, SHORTEST, LENGTH = 7, 3, 64
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, part int, edge string, text string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")]
    + [("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())]
)


def rolling(data: bytes) -> np.ndarray:
    """For each byte a hash of the ``WINDOW`` bytes that end there."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    h = x.copy()
    for k in range(1, min(WINDOW, len(x))):
        h[k:] += x[:-k] * np.uint32(pow(0x9E3779B1, k, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _signature(data: bytes, marks: np.ndarray) -> str:
    ends = (marks[: LENGTH - 1] + 1).tolist()
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    h, at, out = xxhash.xxh32_intdigest, 0, []
    for end in ends:
        out.append(_DIGITS[h(data[at:end]) & 63])
        at = end
    return "".join(out)


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text; the empty text has ``3::``."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return f"{SHORTEST}::"
    block = SHORTEST
    while block * LENGTH < len(data):
        block *= 2
    h = rolling(data)
    while True:
        marks = np.flatnonzero(h % np.uint32(block) == block - 1)
        if len(marks) >= LENGTH // 2 or block == SHORTEST:
            break
        block //= 2
    return f"{block}:{_signature(data, marks)}:{_signature(data, np.flatnonzero(h % np.uint32(2 * block) == 2 * block - 1))}"


def _likeness(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer, or 0 unless they share a run of seven characters."""
    longest = F.greatest(F.length(a), F.length(b))
    runs = F.sequence(F.lit(1), F.length(a) - (WINDOW - 1))
    shared = F.when((F.length(a) >= WINDOW) & (F.length(b) >= WINDOW), F.exists(runs, lambda i: F.instr(b, F.substring(a, i, F.lit(WINDOW))) > 0)).otherwise(F.lit(False))
    return F.when(longest == 0, F.lit(0.0)).when(a == b, F.lit(1.0)).when(shared, F.lit(1.0) - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


def likeness(left: Column, right: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1: the better one of the signatures at equal block sizes.

    Equal fingerprints give 1; block sizes more than a factor of two apart give 0.
    """
    a, b = F.split(left, ":"), F.split(right, ":")
    m, n = a[0].cast("long"), b[0].cast("long")
    return (
        F.when(left == right, F.lit(1.0))
        .when(m == n, F.greatest(_likeness(a[1], b[1]), _likeness(a[2], b[2])))
        .when(m == 2 * n, _likeness(a[1], b[2]))
        .when(n == 2 * m, _likeness(a[2], b[1]))
        .otherwise(F.lit(0.0))
    )


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many first code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of each input row; null texts count as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, texts = columns_of(batch, "doc_id", "text")
            yield batch_of(schema, [ids, [fingerprint(t or "") for t in texts]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _pair(row: tuple, nxt: tuple) -> list:
    """Output row of a document, given (doc_id, text, fingerprint) of it and of the next one."""
    new = edited(row[1], nxt[1])
    return [row[0], len(row[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), row[2], fingerprint(new), nxt[2], None, None, None]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next for each input row.  The next document follows in descending
    doc_id, then by text among rows of one id; nulls come last; after the last
    row comes the first.  Null texts count as empty.  A single row is its own
    next one.

    Texts are sorted once by range of doc_id.  Each task pairs the neighbours it
    holds and hands on its first and last row, two for each task, which a join
    on the task number pairs across tasks.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, prev = TaskContext.get().partitionId(), None, None
        for batch in pieces(batches, 500):
            out = []
            for doc_id, text in zip(*columns_of(batch, "doc_id", "text"), strict=True):
                row = (doc_id, text, fingerprint(text))
                if prev:
                    out.append(_pair(prev, row))
                first, prev = first or row, row
            if out:
                yield batch_of(_ARROW, zip(*out, strict=True))
        if prev:
            yield batch_of(_ARROW, zip(*([r[0], None, None, r[2], None, None, part, edge, r[1]] for r, edge in ((first, "first"), (prev, "last"))), strict=True))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    # the range is set by ids alone: what is sampled for it goes to the driver
    done = cut(rows.repartitionByRange(n, order[0]).sortWithinPartitions(*order).mapInArrow(run, _SCHEMA))

    # tasks that had rows, in order; each one's last row is followed by the next one's first
    parts = sorted(r["part"] for r in done.filter("edge = 'first'").select("part").collect())
    follow = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), T.StructType([T.StructField("part", T.IntegerType()), T.StructField("next_part", T.IntegerType())]))
    edges = done.filter("edge is not null").select("doc_id", "fingerprint", "part", "edge", "text")
    last, first = edges.filter("edge = 'last'").alias("a"), edges.filter("edge = 'first'").alias("b")
    seams = last.join(follow, "part").join(first, F.col("next_part") == F.col("b.part")).select("a.doc_id", "a.text", "a.fingerprint", F.col("b.doc_id").alias("next_id"), F.col("b.text").alias("next_text"), F.col("b.fingerprint").alias("next_fingerprint"))

    def join_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 500):
            a = columns_of(batch, "doc_id", "text", "fingerprint")
            b = columns_of(batch, "next_id", "next_text", "next_fingerprint")
            if batch.num_rows:
                yield batch_of(_ARROW, zip(*(_pair(x, y) for x, y in zip(zip(*a, strict=True), zip(*b, strict=True), strict=True)), strict=True))

    both = done.filter("edge is null").unionByName(seams.mapInArrow(join_seams, _SCHEMA))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
