"""How queries are registered: a function beside the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Types of a fixture's columns in the other engine.
TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


#: Letters as ideographs with readings, for words of them made from words of the tables; z has none.
LETTERS, GLYPHS = "abcdefghijklmnopqrstuvwxyz", "還是海蝕寺紅宏雞碁生深恆痕核化石沿岩腦豆腐龍山丟好中"


def han(text: str) -> str:
    """The statement that writes a text in ideographs."""
    return f"translate(lower({text}), '{LETTERS}', '{GLYPHS}')"


def pick(choices: str, number: str) -> str:
    """The statement that takes one of some words, apart by commas, by a number."""
    return f"split_part('{choices}', ',', CAST({number} % {choices.count(',') + 1} + 1 AS INT))"


#: Line items by order and number, which some share.
ITEMS = "(SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_discount) AS d, min(l_tax) AS t, min(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber)"

#: Line items that one task groups.
TASK_ROWS = 1_250_000


def item_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that share the line items: as many as their number asks for, and no fewer than there are cores."""
    rows = table(spark, sf_dir, "lineitem").count()
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


class Fixture:
    """Rows that both engines derive from the given tables by one statement, and a few inline ones at the edges.

    The statement is SQL that both understand; ``{list}`` stands for the function
    that makes an array.  Its columns are those of the schema, in order.  Where
    a plain statement grows faster than its rows, ``lean`` is one with the same
    rows for Spark.
    """

    def __init__(self, schema: str, rows: list[tuple], derived: str = "", lean: str = ""):
        self.schema, self.rows, self.derived, self.lean = schema, rows, derived, lean or derived
        self.fields = [tuple(c.strip().split(" ")) for c in schema.split(",")]
        self.names = [n for n, _ in self.fields]

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        inline = spark.createDataFrame(self.rows, self.schema)
        if not self.derived:
            return inline
        statement = self.lean.replace("{list}", "array")
        if ITEMS in statement:
            # dealt out by count before they are grouped: else a task groups all lines of a file's part, then all that fit in a partition's bytes
            dealt = f"FROM (SELECT /*+ REPARTITION({item_tasks(spark, sf_dir)}, l_orderkey) */ * FROM lineitem) GROUP BY"
            statement = statement.replace(ITEMS, ITEMS.replace("FROM lineitem GROUP BY", dealt))
        statement = re.sub(r"\b(FROM|JOIN) ([a-z]+)\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", statement)
        found = spark.sql(statement).toDF(*self.names)
        return inline.unionByName(found.select(*(F.col(n).cast(t) for n, t in self.fields)))

    @property
    def sql(self) -> str:
        def literal(x) -> str:
            if x is None:
                return "NULL"
            if isinstance(x, bool):
                return str(x).upper()
            if isinstance(x, float):
                return f"{x!r}::DOUBLE"
            if isinstance(x, str):
                return "'" + x.replace("'", "''") + "'"
            if isinstance(x, list):
                return "[" + ", ".join(map(literal, x)) + "]"
            return str(x)

        typed = ", ".join(f"{n}::{TYPES[t]} AS {n}" for n, t in self.fields)
        names = ", ".join(self.names)
        rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        inline = f"SELECT {typed} FROM (VALUES {rows}) AS f({names})"
        more = f" UNION ALL SELECT {typed} FROM ({self.derived.replace('{list}', 'list_value')}) AS g({names})" if self.derived else ""
        return f"({inline}{more})"
