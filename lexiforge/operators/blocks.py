"""A stated set of queries against all rows of a table, vectors as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that go to every task at once; more are dealt out in blocks of so many.
QUERY_BLOCK = 2048
#: Rows that meet a block of queries in one task.
PACK_ROWS = 1 << 19
#: Scores held at once in a task.
SCORES = 1 << 22


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector stays zero."""
    n = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def against_all(rows: DataFrame, queries: DataFrame, meet: Callable[[pa.Table, pa.Table], Iterator[pa.Table]], result: T.StructType, block: int = QUERY_BLOCK, pack: int = PACK_ROWS) -> DataFrame:
    """What ``meet`` makes of some rows and some queries, over all pairs of such sets; both have a column ``id``.

    Up to ``block`` queries go to every task, and rows stay where they are.
    More are dealt out: blocks of queries meet packs of rows, each pair of sets
    in a task of its own, so that neither side has to fit one, and nothing goes
    through the driver.
    """
    n = queries.count()
    if n <= block:
        sent = queries.sparkSession.sparkContext.broadcast(queries.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and sent.value.num_rows:
                    for out in meet(pa.Table.from_batches([batch]), sent.value):
                        yield from out.to_batches()

        return rows.mapInArrow(scan, result)
    blocks, packs = -(-n // block), max(1, -(-rows.count() // pack))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    names = result.names

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(meet(left.drop_columns(["pack", "block"]), right.drop_columns(["pack", "block"]))) if left.num_rows and right.num_rows else []
        return pa.concat_tables(found) if found else pa.table({c: pa.array([]) for c in names}).cast(to_arrow(result))

    left, right = dealt(rows, "pack", packs, "block", blocks), dealt(queries, "block", blocks, "pack", packs)
    return left.groupBy("pack", "block").cogroup(right.groupBy("pack", "block")).applyInArrow(pair, result)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def best_rows(rows: int, score: Callable[[int, int], np.ndarray], queries: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the places and scores of its ``most`` best rows; ``score(a, b)`` scores rows a to b, a row for each query."""
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0))] * queries
    step = max(1, SCORES // max(1, queries))
    for at in range(0, rows, step):
        for q, row in enumerate(score(at, min(rows, at + step))):
            top = np.flatnonzero(row >= -np.partition(-row, most - 1)[most - 1]) if len(row) > most else np.arange(len(row))  # ties with the last place stay
            i, s = np.concatenate([best[q][0], at + top]), np.concatenate([best[q][1], row[top]])
            if len(s) > most:
                keep = s >= -np.partition(-s, most - 1)[most - 1]
                i, s = i[keep], s[keep]
            best[q] = i, s
    for q, (i, s) in enumerate(best):
        if len(i):
            yield q, i, s
