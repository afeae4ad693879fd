"""Edits carried through to the derived tables give what building them anew gives."""

import random

from lexiforge.operators import edits as D
from lexiforge.sources.tablelog import TableLog


def note(r, k):
    return (f"t{k}", r.choice(["x", "y", "z", ""]), r.random() < 0.4, [f"v{r.randint(0, 2)}"] * r.randint(0, 1), [f"t{r.randint(0, 40)}" for _ in range(r.randint(0, 3))] + [f"domains/{r.choice('abc')}"] * r.randint(0, 2))


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_edits_equal_a_rebuild(spark, tmp_path):
    r = random.Random(5)
    notes = TableLog(spark, f"file://{tmp_path}/notes", D.NOTES)
    views = D.Views(notes, f"file://{tmp_path}/views")
    make = lambda ks: spark.createDataFrame([note(r, k) for k in ks], D.NOTES)
    notes.append(make(range(30)))
    views.refresh()
    for step in range(5):
        if step == 1:
            notes.delete(make(r.sample(range(30), 4)).select("term"), ["term"])
        elif step == 3:  # two edits before the tables follow, as after a crash
            notes.upsert(make([1, 2, 33]), ["term"])
            notes.delete(make([2, 5]).select("term"), ["term"])
        else:
            notes.upsert(make(r.sample(range(42), 3)), ["term"])
        touched = views.refresh()
        want = D.rebuilt(notes.read())
        for name, df in want.items():
            assert rows(getattr(views, name).read().select(df.columns)) == rows(df), (step, name)
        assert touched["counts"] <= 4 and touched["seed"] <= 12
    assert views.refresh() == {}


def test_rows_touched_grow_with_the_edit(spark, tmp_path):
    notes = TableLog(spark, f"file://{tmp_path}/notes", D.NOTES)
    notes.append(spark.range(2000).selectExpr("concat('t', id) AS term", "concat('c', id % 7) AS category", "id % 5 = 0 AS is_special", "array('v') AS variants", "array(concat('t', (id + 1) % 2000), concat('domains/d', id % 9)) AS links").repartition(4))
    views = D.Views(notes, f"file://{tmp_path}/views")
    assert views.refresh() == {"edges": 4000, "degrees": 9, "counts": 7, "seed": 400}
    # renaming one term: its own links, the one that led to it, and its counts
    notes.upsert(spark.createDataFrame([("renamed", "c1", True, ["v", "t10"], ["t11", "domains/d1"])], D.NOTES), ["term"], keys=spark.createDataFrame([("t10",)], "term string"))
    assert views.refresh() == {"edges": 5, "degrees": 0, "counts": 2, "seed": 2}
    assert views.edges.read().count() == 3999
    assert notes.changes(0, 1).count() == 2
