"""A stored index for neighbours by cosine: short codes to look through, exact scores for the best.

Unit vectors are cut into pieces of ``width`` dimensions, each known by the
nearest of up to 256 centres.  A search scans the codes, an eighth of the
vectors' bytes or less, and reads whole vectors only of the few best rows.
The centres are fitted once, on a bounded sample; rows are coded with them as
they come, so the index grows by appending.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.operators.blocks import PACK_ROWS, QUERY_BLOCK, against_all, best_rows, matrix, unit
from lexiforge.sources.tablelog import TableLog

#: Rows that the centres are fitted on: the first ones by a hash of the id.
SAMPLE = 8192
ROWS = 1 << 19
#: Scores held at once in a task.
SCORES = 1 << 22

ROWS = "id {id}, code binary, vec array<float>"
MODEL = "width int, dims int, centres array<binary>"


def fit_centres(x: np.ndarray, width: int, rounds: int = 10) -> list[np.ndarray]:
    """Up to 256 centres for each piece of ``width`` dimensions (the last may be shorter), by k-means on the rows of ``x``."""
    out = []
    for first in range(0, x.shape[1], width):
        piece = x[:, first : first + width]
        centres = np.unique(piece[np.linspace(0, len(piece) - 1, min(256, len(piece))).astype(int)], axis=0)
        for _ in range(rounds):
            of = nearest(piece, centres)
            n = np.bincount(of, minlength=len(centres))
            for d in range(piece.shape[1]):
                sums = np.bincount(of, piece[:, d], minlength=len(centres))
                centres[:, d] = np.where(n > 0, sums / np.maximum(n, 1), centres[:, d])
        out.append(centres)
    return out


def nearest(piece: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * piece @ centres.T, axis=1)


def codes_of(x: np.ndarray, centres: list[np.ndarray]) -> np.ndarray:
    """One byte for each piece of each row."""
    out, first = np.empty((len(x), len(centres)), np.uint8), 0
    for i, c in enumerate(centres):
        out[:, i] = nearest(x[:, first : first + c.shape[1]], c)
        first += c.shape[1]
    return out


def decoded(codes: np.ndarray, centres: list[np.ndarray]) -> np.ndarray:
    """Vectors that the codes stand for, looked up piece by piece."""
    return np.concatenate([c[codes[:, i]] for i, c in enumerate(centres)], axis=1)


class VectorIndex:
    """The index under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        self.id_type = id_type
        self.rows = TableLog(spark, f"{self.path}/rows", ROWS.format(id=id_type))
        self.models = TableLog(spark, f"{self.path}/model", MODEL)

    @property
    def centres(self) -> list[np.ndarray]:
        row = self.models.read().first()
        if row is None:
            raise KeyError(f"no index under {self.path}")
        return [np.frombuffer(bytes(c)).reshape(-1, min(row.width, row.dims - i * row.width)) for i, c in enumerate(row.centres)]

    def build(self, cards: DataFrame, width: int = 2) -> VectorIndex:
        """Fit the centres on a sample of ``cards`` (id, vec) and take all of them in; an index that is there is replaced.

        Null vectors and null ids are left out; vectors have one length.
        """
        held = cards.filter("id is not null and vec is not null")
        sample = held.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toPandas()["vec"]
        if not len(sample):
            raise ValueError("an index needs at least one vector")
        x = unit(np.array(sample.tolist(), dtype=np.float64))
        self.models.replace(self.spark.createDataFrame([(width, x.shape[1], [bytearray(c.tobytes()) for c in fit_centres(x, width)])], MODEL))
        self.rows.replace(self._coded(held.dropDuplicates(["id"])))
        return self

    def append(self, cards: DataFrame) -> int:
        """Take in cards whose id is new, without touching the others; how many were taken in."""
        cards = cards.filter("id is not null and vec is not null").dropDuplicates(["id"])
        version = self.rows.insert_new(lambda held: self._coded(cards.join(held.select("id"), "id", "left_anti")))
        return self.rows.added(version).count()

    def _coded(self, cards: DataFrame) -> DataFrame:
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    code = codes_of(unit(matrix(batch.column("vec"))), centres)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("vec")], names=["id", "code", "vec"])

        return cards.select("id", F.col("vec").cast("array<float>").alias("vec")).mapInArrow(run, self.rows.schema)

    def candidates(self, queries: DataFrame, most: int, block: int = QUERY_BLOCK, pack: int = PACK_ROWS) -> DataFrame:
        """query, id, approx: the ``most`` best rows for each query (id, vec) by their codes alone."""
        centres = self.centres
        result = T.StructType([T.StructField("query", queries.schema["id"].dataType), T.StructField("id", self.rows.schema["id"].dataType), T.StructField("approx", T.DoubleType())])

        def meet(rows: pa.Table, asked: pa.Table) -> Iterator[pa.Table]:
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            q = unit(matrix(asked.column("vec")))
            for place, of, score in best_rows(len(code), lambda a, b: q @ decoded(code[a:b], centres).T, len(q), most):
                yield pa.table({"query": asked.column("id").take(pa.array([place] * len(of))), "id": rows.column("id").take(pa.array(of)), "approx": score})

        best = against_all(self.rows.read().select("id", "code"), queries.select("id", "vec"), meet, result, block, pack)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("approx"), "id"))
        return best.withColumn("place", rank).filter(F.col("place") <= most).drop("place")

    def rerank(self, k: int) -> int:
        """Rows whose vectors are read for each query: a few more than ``k`` in a small index, up to 50 times ``k`` in a large one."""
        return max(k + 3, min(50 * k, self.rows.read().count() // 500))

    def search(self, queries: DataFrame, k: int, rerank: int | None = None, floor: float | None = None) -> DataFrame:
        """query, card, score, rank: the k cards nearest to each query (id, vec), scored exactly among the candidates.

        Query ids are unique.  A query that is a card finds itself.
        """
        near = self.candidates(queries, rerank or self.rerank(k))
        cards = self.rows.read().select("id", F.col("vec").alias("c_vec"))
        asked = queries.select(F.col("id").alias("query"), F.col("vec").cast("array<double>").alias("q_vec"))
        pairs = near.select("query", "id").join(cards, "id").join(asked, "query")

        def cosines(a: pd.Series, b: pd.Series) -> pd.Series:
            if not len(a):
                return pd.Series([], dtype="float64")
            x, y = (unit(np.array(v.tolist(), dtype=np.float64)) for v in (a, b))
            return pd.Series(np.round((x * y).sum(axis=1), 6) + 0.0)

        scored = pairs.select("query", F.col("id").alias("card"), F.pandas_udf(cosines, "double")("q_vec", "c_vec").alias("score"))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "card"))).filter(F.col("rank") <= k)
        return ranked.filter(F.col("score") >= floor) if floor is not None else ranked
