"""Steps whose memory in one task would grow with what a join makes of its rows."""

import re

from lexiforge.plans import catalogue, registry
from tests.compare import check, connect

SMALL = "/root/testdata/sf0.001"


def dealt_before_ranked(df) -> bool:
    """Whether mentions are ranked only behind the exchange by query and word, not in the tasks of the join as well."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") < plan.find("REPARTITION_BY_COL")


def test_anchors_are_dealt_before_they_are_ranked(spark):
    df = catalogue.QUERIES["anchor_union"](spark, SMALL)
    assert dealt_before_ranked(df)
    check(df, catalogue.ORACLE_SQL["anchor_union"], connect(SMALL))


def test_evidence_takes_anchors_that_are_dealt_once(spark):
    df = catalogue.QUERIES["semantic_evidence"](spark, SMALL)
    assert dealt_before_ranked(df)
    check(df, catalogue.ORACLE_SQL["semantic_evidence"], connect(SMALL))


def test_line_items_are_dealt_by_count_before_they_are_grouped(spark, monkeypatch):
    monkeypatch.setattr(registry, "TASK_ROWS", 500)
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    df = catalogue.QUERIES["semantic_evidence"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(l_orderkey#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)
    assert dealt and set(dealt) == {str(-(-rows // 500))}
    # no task groups what it reads of the file, and words asked for are not dealt once more
    assert not re.search(r"Exchange hashpartitioning\((l_orderkey|o)#\d+L, (l_linenumber|w)#", plan)
    assert not re.search(r"partial_min.*\n[ :+\-]*(Filter.*\n[ :+\-]*)?FileScan", plan)
    check(df, catalogue.ORACLE_SQL["semantic_evidence"], connect(SMALL))
