"""Queries on tables where a cut or a join of everything with everything shows."""

import pytest

from lexiforge.plans import catalogue, evidence_queries, registry
from tests.compare import check, connect, rows_of

LARGER = "/root/testdata/sf0.1"


def test_edges_of_all_notes(spark):
    """There are more notes than a view shows at once."""
    check(catalogue.QUERIES["edge_build"](spark, LARGER), catalogue.ORACLE_SQL["edge_build"], connect(LARGER))


@pytest.mark.parametrize("name", ["SPELLED", "WRITTEN"])
def test_names_meet_once_for_each_size(spark, name):
    fixture = getattr(evidence_queries, name)
    lean = fixture.df(spark, LARGER)
    plain = registry.Fixture(fixture.schema, fixture.rows, fixture.derived).df(spark, LARGER)
    assert rows_of(lean.columns, lean.collect()) == rows_of(plain.columns, plain.collect())
    # both sides of the join fold before they meet, and the pairs fold behind it
    assert lean._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3
