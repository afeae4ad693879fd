"""Tables written once in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lists of the tables written by the calls of ``staged`` that are open in this context; threads have their own.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open tables", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can see: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a session on one machine gets a temporary folder,
    kept in its settings for later calls; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lexiforge.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexiforge-")
        spark.conf.set("lexiforge.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written table replaces the lineage, so an executor lost later costs no
    recomputation, and its size is known to the optimizer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _OPEN.get()[-1:]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged(make: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``make`` as a written table; the tables that it wrote on the way are removed."""
    paths: list[str] = []
    token = _OPEN.set((*_OPEN.get(), paths))
    try:
        out = cut(make())
    finally:
        _OPEN.reset(token)
    for outer in _OPEN.get()[-1:]:
        outer.append(paths[-1])
    spark = out.sparkSession
    for path in paths[:-1]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return out


def bytes_within(df: DataFrame, limit: int) -> bool:
    """Whether the rows of ``df``, a written table, hold at most ``limit`` bytes, counted."""
    sizes = [F.sum(_size(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields]
    return sum(v or 0 for v in df.agg(*sizes).first()) <= limit


def _size(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value, 8 for numbers and for each length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column).cast("long") + 8
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(column, F.lit(8).cast("long"), lambda acc, x: acc + _size(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = sum((_size(column[f.name], f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    else:
        size = F.lit(8).cast("long")
    return F.coalesce(size, F.lit(8).cast("long"))


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df`` as a written table, with a broadcast hint if its bytes were counted and are at most ``most``."""
    df = cut(df)
    return F.broadcast(df) if bytes_within(df, most) else df
