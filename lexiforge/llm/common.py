"""Helpers shared by the operators: joins over hot keys, sizes and stable hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.written import bytes_within, cut, shared_dir, staged

__all__ = ["WORD", "batch_of", "bytes_within", "columns_of", "cut", "doc_bucket", "meet", "pieces", "shared_dir", "staged"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def meet(left: DataFrame, right: DataFrame, on: list[str], rows: str | None = None, hot: int = 5000, least: int = 1000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Inner join of ``left``, a written table in which keys may be hot, with ``right``, which has one row for each key.

    ``rows`` names the column of ``right`` that counts the key's rows of ``left``, if it has one.

    A key with over 1 / ``hot`` of the rows (and over ``least`` rows) is hot, so
    there are at most ``hot`` such keys; their rows of ``right`` are
    counted in bytes and go to every task, and only the other keys are shuffled.
    Hot rows too large for that are shuffled as well.
    """
    n = left.count()
    if n <= least:
        return left.join(right, on)
    limit = max(least, n // hot)
    if rows:
        heavy = cut(right.filter(F.col(rows) > limit))
    else:
        keys = left.groupBy(*on).agg(F.count("*").alias("rows of the key")).filter(F.col("rows of the key") > limit)
        heavy = cut(right.join(F.broadcast(cut(keys.select(*on))), on, "left_semi"))
    if not bytes_within(heavy, broadcast_bytes):
        return left.join(right, on)
    rare = left.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(right, on)
    return rare.unionByName(left.join(F.broadcast(heavy), on))


def doc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold a document belongs to."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def columns_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
