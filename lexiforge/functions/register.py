"""SQL names for the functions and table functions of the library."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.languages import BLOCKS
from lexiforge.functions.text import PUNCT
from lexiforge.sources.office import json_objects, sheet_rows, tuples


class SqlDumpRows:
    def eval(self, line: str) -> Iterator[tuple]:
        yield from enumerate(tuples(line or ""))


class JsonObjects:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(json_objects(text))


class SheetRows:
    def eval(self, content: bytes) -> Iterator[tuple]:
        yield from sheet_rows(bytes(content))


def register(spark: SparkSession) -> list[str]:
    """Register strip_punct, cosine, script_of and the table functions; returns their names.

    The scalar ones are SQL functions, which the optimizer sees through.
    """
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)"
    norm = f"sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')})"
    signs = PUNCT.replace("\\", "\\\\").replace("'", "\\'")
    scripts = " ".join(f"WHEN c RLIKE '^[{b}]' THEN '{s}'" for s, _, b in BLOCKS)
    for head, body in (
        ("strip_punct(t STRING) RETURNS STRING", f"regexp_replace(coalesce(t, ''), '[{signs}]+', '')"),
        ("cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE", f"CASE WHEN {norm} = 0 THEN CAST(0 AS DOUBLE) ELSE {dot.format('a', 'b')} / ({norm}) END"),
        ("script_of(c STRING) RETURNS STRING", f"CASE {scripts} ELSE 'Zyyy' END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, udtf, schema in (("sql_dump_rows", SqlDumpRows, "pos int, fields array<string>"), ("json_objects", JsonObjects, "pos int, object string"), ("sheet_rows", SheetRows, "sheet string, row int, cells array<string>")):
        spark.udtf.register(name, F.udtf(udtf, returnType=schema))
    return ["strip_punct", "cosine", "script_of", "sql_dump_rows", "json_objects", "sheet_rows"]
