"""Copies of one line with some words changed: they meet where they share a change."""

import random

from lexiforge.llm import linededup
from tests.llm.test_linededup import brute_lines, compare
from tests.llm.test_operators import by_id, docs_of


def test_a_family_is_no_single_group(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base, rows = [word() for _ in range(60)], []
    for i in range(150):
        t = list(base)
        for k in r.sample(range(60), 4 if i else 0):
            t[k] = word()
        rows.append((i, " ".join(t), "en", "a"))
    most, run = [], linededup.block_pairs
    monkeypatch.setattr(linededup, "block_pairs", lambda a, *rest: (most.append(a.groupBy("t").count().agg({"count": "max"}).first()[0] or 0), run(a, *rest))[1])
    linededup.line_report(docs_of(spark, rows)).count()
    assert most and most[0] < 75


def test_a_line_stands_once_beside_each_earliest_line(spark, monkeypatch):
    """Copies of one line share many keys; their parts are listed once, not once for each key."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base, rows = [word() for _ in range(60)], []
    for i in range(150):
        t = list(base)
        for k in r.sample(range(60), (0, 2, 3, 4)[i % 4] if i else 0):
            t[k] = word()
        if i > 100 and i % 3 == 0:  # near an earlier copy, not near the first line
            t = rows[i - 50][1].split(" ")
            t[i % 60] = word()
        rows.append((i, " ".join(t), "en", "a"))
    seen, run = [], linededup.rare_parts
    monkeypatch.setattr(linededup, "rare_parts", lambda seats, *rest: (seen.append((seats.count(), seats.select("h1", "h2").distinct().count())), run(seats, *rest))[1])
    compare(by_id(linededup.line_report(docs_of(spark, rows))), brute_lines(rows))
    assert seen and all(0 < n < 1.5 * lines for n, lines in seen), seen
