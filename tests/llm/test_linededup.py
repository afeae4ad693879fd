import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.llm import linededup
from tests.llm.test_operators import by_id, docs_of, random_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(r, text, k):
    t = list(text)
    for _ in range(k):
        o, i = r.choice("sid"), r.randrange(len(t) + 1)
        if o == "i":
            t.insert(i, r.choice("abcé "))
        elif t and o == "d":
            t.pop(min(i, len(t) - 1))
        elif t:
            t[min(i, len(t) - 1)] = r.choice("abcé ")
    return "".join(t)


def reworded(r, line, k, word):
    t = line.split(" ")
    for _ in range(k):
        o, i = r.choice("sssid"), r.randrange(len(t))
        t[i : i + (o != "i")] = [word()] if o != "d" else []
    return " ".join(t)


def near(a, b, edits=2):
    x, y = a.split(" "), b.split(" ")
    n = min(len(x), len(y))
    if n < linededup.WORDS_FROM:
        return abs(len(a) - len(b)) <= edits and distance(a, b) <= edits
    return abs(len(x) - len(y)) <= linededup.WORD_EDITS and distance(x, y) <= linededup.WORD_EDITS


def brute_lines(rows, least=24, edits=2):
    """{id: (exact, near, kept text)} by comparing every line with all earlier ones."""
    seen, out = [], {}
    for i, t, *_ in sorted(rows, key=lambda x: x[0]):
        exact = close = 0
        kept = []
        for line in (t or "").split("\n"):
            bare = line.strip(" ")
            if len(bare) >= least:
                v = bare.lower()
                if v in seen:
                    exact += 1
                    continue
                hit = any(near(v, x, edits) for x in seen)
                seen.append(v)
                if hit:
                    close += 1
                    continue
            kept.append(line)
        out[i] = (exact, close, "\n".join(kept))
    return out


def compare(got, want):
    for i, (exact, close, kept) in want.items():
        assert (got[i].n_exact, got[i].n_near) == (exact, close), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


@pytest.fixture(scope="module")
def words():
    r = random.Random(12)
    return r, lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    r = random.Random(edits)
    pairs = []
    for k in range(300):
        a = "".join(r.choice("abcé ") for _ in range(r.randint(0, 30)))
        pairs.append((k, a, mutated(r, a, r.randint(0, 4))))
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    assert {x.i for x in linededup.within_distance(df, "a", "b", edits).collect()} == {k for k, a, b in pairs if distance(a, b) <= edits}
    by_words = {x.i for x in linededup.within_distance(df, "a", "b", edits, " ").collect()}
    assert by_words == {k for k, a, b in pairs if distance(a.split(" "), b.split(" ")) <= edits}


def test_short_lines(spark):
    r = random.Random(8)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(24, 60))) for _ in range(25)] + ["short", "", "  "]
    rows = [(i, "\n".join(mutated(r, r.choice(lines), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(1, 8))), "en", "a") for i in range(40)] + [(900, None, "en", "a"), (901, "", "en", "a")]
    want = brute_lines(rows)
    for limit in (16 << 20, 0):
        compare(by_id(linededup.line_report(docs_of(spark, rows), broadcast_bytes=limit)), want)
    left = linededup.drop_repeated_lines(docs_of(spark, rows))
    assert left.columns == docs_of(spark, []).columns and {900, 901} <= {x.doc_id for x in left.collect()}


def test_the_limit_grows_with_length(spark, words):
    r, word = words
    base = [" ".join(word() for _ in range(n)) for n in (18, 19, 20, 21, 22, 24, 25, 31, 32, 70)]
    rows = [(i, reworded(r, base[i % 10], k, word), "en", "a") for i, k in enumerate([0] * 10 + [r.randint(0, 5) for _ in range(150)])]
    rows += [(200 + i, mutated(r, base[i % 10], 2), "en", "a") for i in range(60)]
    rows += [(900, "menu", "en", "a"), (901, "Menu \nother", "en", "a")]
    want = brute_lines(rows, 1)
    compare(by_id(linededup.line_report(docs_of(spark, rows), min_exact=1)), {i: x for i, x in want.items() if i < 900})
    got = by_id(linededup.line_report(docs_of(spark, rows), min_exact=1))
    assert sum(x[1] for x in want.values()) > 60 and (got[900].n_exact, got[901].n_exact) == (0, 1)


def test_large_groups_without_all_their_pairs(spark, words, monkeypatch):
    r, word = words
    base, menu = [word() for _ in range(60)], [word() for _ in range(8)]
    rows = []
    for i in range(240):  # one family whose members differ from each other more than from its first line
        t = list(base)
        for _ in range(0 if i == 0 else r.randint(0, 6)):
            t[r.randrange(60)] = r.choice(menu) if i % 5 == 0 else word()
        rows.append((i, " ".join(t), "en", "a"))
    rows += [(1000 + i, f"the number of the {i * 7919 % 100003:06d} th item in this list", "en", "a") for i in range(160)]
    monkeypatch.setattr(linededup, "BLOCK", 64)
    pairs, run = [], linededup.near_ones
    monkeypatch.setattr(linededup, "near_ones", lambda p, *a: (pairs.append(p.distinct().count()), run(p, *a))[1])
    compare(by_id(linededup.line_report(docs_of(spark, rows))), brute_lines(rows))
    assert sum(pairs) < 4 * len(rows), pairs


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_near_strings_share_a_segment(edits):
    r = random.Random(edits)

    def keys(n, text):
        out = set()
        for below in (0, 1) if n % linededup.CLASS < edits else (0,):
            number = n // linededup.CLASS - below
            size = number * linededup.CLASS // (edits + 1)
            for i, right, shift in linededup.probes(edits):
                at = (n - (edits + 2 - i) * size if right else (i - 1) * size) + shift
                out.add((number, i, text[at : at + size]))
        return out

    for _ in range(3000):
        a = "".join(r.choice("ab") for _ in range(r.randint(24, 60)))
        b = mutated(r, a, edits)
        assert keys(len(a), a) & keys(len(b), b), (a, b)


def test_edges(spark):
    empty, docs = docs_of(spark, []), docs_of(spark, random_rows())
    assert linededup.line_report(empty).count() == 0 and linededup.line_report(docs).count() == docs.count()
    line = "this line is here more than once in all"
    odd = spark.createDataFrame([(5, f"{line}\nx", 1, 2, 3, 4, 5), (5, f"{line}\nx", 1, 2, 3, 4, 5), (5, line, 1, 2, 3, 4, 5), (None, line, 1, 2, 3, 4, 5), (7, "y " * 30000, 1, 2, 3, 4, 5)], "doc_id long, text string, __id long, __hash long, __kept long, `a.b` long, near long")
    left = linededup.drop_repeated_lines(odd, min_exact=1)
    # the row without an id comes first and keeps the line; equal rows lose it alike, a row of nothing else goes
    assert left.columns == odd.columns and sorted((x.doc_id or 0, x.text[:40], x["a.b"]) for x in left.collect()) == [(0, line, 4), (5, "x", 4), (5, "x", 4), (7, ("y " * 20), 4)]


def test_words_of_one_hash_hide_no_line(spark):
    """Lines that only look near, as two of their words share a glyph, stand before the line that is near."""
    words = spark.createDataFrame([(f"word{i}",) for i in range(4000)], "w string").select("w", linededup.glyphs(F.col("w")).alias("g"))
    pair = words.groupBy("g").agg(F.collect_list("w").alias("ws")).filter("size(ws) > 1").first().ws[:2]
    base = [f"filler{k}" for k in range(24)]
    later = " ".join([pair[0], *base])
    false = [" ".join([pair[1], *base[:20], f"x{k}", f"y{k}", *base[22:]]) for k in range(60)]
    true = " ".join([pair[0], *base[:20], "z", *base[21:]])
    rows = [(i, 0, line, len(false) + 1) for i, line in enumerate([*false, true])] + [(1000, 0, later, len(false) + 1)]
    lines = spark.createDataFrame([(h1, h2, h1, line, 7, n, 25) for h1, h2, line, n in rows], "h1 long, h2 long, first int, line string, t int, size int, words int").withColumn("glyphs", linededup.glyphs(F.col("line")))
    got = {(r.a1, r.b1) for r in linededup.block_pairs(lines, lines.filter("h1 = 1000"), 2).collect()}
    assert got == {(len(false), 1000)}
