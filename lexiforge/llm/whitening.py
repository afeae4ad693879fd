"""Whitening of embeddings by principal components of a covariance that is merged pairwise.

Each partition computes count, mean and centred scatter of its vectors; the
pairwise formula of Chan, Golub and LeVeque merges two such states,

    M = Ma + Mb + (mean_b - mean_a)(mean_b - mean_a)' * na * nb / (na + nb),

in a tree over the executors, so the driver gets a few states of one
dimension-by-dimension matrix each.  It takes the eigenvectors, and a second
pass of the same kind over the whitened vectors measures how far their
covariance is from the identity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, pieces

SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this size do not fit a long once scaled.
LARGEST = 2.0**55
#: Entries of a matrix worked on at once.
ENTRIES = 1 << 20


@dataclass
class Moments:
    """Count, sums (exact integers; floats for whitened vectors) and centred scatter of some vectors."""

    n: int
    sums: list
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        """Moments of the rows of a matrix; whole numbers are first moved by one near their mean, which is exact."""
        if rows.dtype.kind == "f":
            sums, near = list(rows.sum(axis=0)), rows.copy()
        else:
            wide = max(abs(int(rows.min())), abs(int(rows.max()))) * len(rows) >= 2**62
            sums = [int(s) for s in rows.sum(axis=0, dtype=object if wide else np.int64)]
            near = (rows - np.array([s // len(rows) for s in sums])).astype(np.float64)
        near -= near.mean(axis=0)
        return Moments(len(rows), sums, near.T @ near)

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        # whole numbers of any size until the division, so large equal means cancel exactly
        apart = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.scatter + other.scatter + np.outer(apart, apart) * (self.n / n * other.n))


@dataclass
class Whitening:
    """Fitted transform: ``values`` (falling) and ``vectors`` (columns) of the covariance of ``n`` vectors with ``sums``.

    ``live`` marks components with variance beyond rounding.
    """

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    live: np.ndarray

    @staticmethod
    def fit(m: Moments, components: int) -> Whitening:
        covariance = m.scatter / m.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = np.maximum(values[::-1][:components], 0), vectors[:, ::-1][:, :components]
        trace = float(np.trace(covariance))
        return Whitening(m.n, m.sums, values, vectors, trace, values > trace * len(m.sums) * 1e-14)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; as Python integers where squares summed up would not fit a long."""
        ends = np.stack([x.min(axis=0), x.max(axis=0)])
        widest = max(abs(self.n * int(v) - s) for row in ends for v, s in zip(row, self.sums, strict=True))
        fits = max(map(abs, self.sums)) < 2**62 and self.n * int(np.abs(ends).max()) < 2**62 and widest**2 * len(self.sums) < 2**63
        kind = np.int64 if fits else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def whiten(self, apart: np.ndarray) -> np.ndarray:
        out = np.zeros((len(apart), len(self.values)))
        out[:, self.live] = (apart / self.n).astype(np.float64) @ self.vectors[:, self.live] / np.sqrt(self.values[self.live])
        return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column without nulls as one matrix over the column's own memory."""
    return column.flatten().to_numpy().reshape(-1, dims)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the usable rows and the number of dimensions.

    x = floor(64 c) + 1000000 of each entry c.  Rows go whose vector is null or
    empty, holds a null, non-finite or too large (2 ** 55) entry, or has another
    length than most usable vectors (of equally common lengths the larger).
    """
    c = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.size(c) > 0).filter(F.forall(c, lambda v: F.coalesce(F.abs(v) < LARGEST, F.lit(False))))
    lengths = rows.groupBy(F.size(c).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths["dims"] if lengths else 0
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + F.lit(OFFSET).cast("long"))
    return rows.filter(F.size(c) == dims).select("vec_id", x.alias("x")), dims


def moments(vectors: DataFrame, dims: int, model: Whitening | None = None) -> Moments:
    """Moments of the column ``x`` (of its whitened form if ``model`` is given), merged in a tree on the executors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Moments(0, [], np.zeros(0))
        for batch in pieces(batches, max(1, ENTRIES // dims)):
            x = _matrix(batch.column("x"), dims)
            out = out.merge(Moments.of(model.whiten(model.apart(x)) if model else x))
        if out.n:
            yield pa.RecordBatch.from_pydict({"n": [out.n], "sums": [[str(s) if model is None else float(s).hex() for s in out.sums]], "scatter": [out.scatter.tobytes()]})

    def state(row) -> Moments:
        sums = [int(s) if model is None else float.fromhex(s) for s in row.sums]
        return Moments(row.n, sums, np.frombuffer(bytes(row.scatter)).reshape(len(sums), len(sums)))

    states = vectors.select("x").mapInArrow(partial, "n long, sums array<string>, scatter binary").rdd.map(state)
    depth = max(2, math.ceil(math.log(max(states.getNumPartitions(), 2), 8)))
    return states.treeAggregate(Moments(0, [], np.zeros(0)), Moments.merge, Moments.merge, depth)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    ``quantised`` says which rows are usable and how entries become whole
    numbers.  The fit counts equal vectors once, however many rows share one:
    copies fold before the shuffle, so a hot vector is no hot task.  Repeated
    and null ids keep their rows; no usable rows give an empty result.

    Components with no variance beyond rounding (constant vectors, fewer vectors
    than dimensions) have whitened 0 and do not count in ``identity_error``,
    which is 0 if none is left; ``explained`` is 0 where all vectors are equal.
    ``deviation`` is exact, and null beyond a long.

    The fit list is written once and read by both passes; rows are whitened
    where they are read.  Each partition holds one matrix of dims * dims
    doubles and slices of an Arrow batch.
    """
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dims = quantised(vectors, id_col, vector_col)
    if not dims:
        return vectors.sparkSession.createDataFrame([], result)
    fit_list = cut(rows.select("x").distinct())
    model = Whitening.fit(moments(fit_list, dims), components)
    k = len(model.values)
    second = moments(fit_list, dims, model)
    left = (second.scatter / second.n - np.eye(k))[np.ix_(model.live, model.live)]
    error = float(np.abs(left).max(initial=0.0))
    explained = model.values / model.trace if model.trace else np.zeros(k)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, max(1, ENTRIES // dims)):
            rows, apart = batch.num_rows, model.apart(_matrix(batch.column("x"), dims))
            deviation = [d if d < 2**63 else None for d in map(int, (apart * apart).sum(axis=1))]
            each = np.repeat(np.arange(rows), k)
            yield batch_of(
                schema,
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(model.whiten(apart).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
            )

    return rows.mapInArrow(run, result)
