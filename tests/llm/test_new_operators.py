"""Whitening, the Merkle manifest and the URL filter against plain forms of their definitions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import merkle, oracles, queries, urlfilter, whitening
from tests.compare import DATA, check, connect
from tests.llm.test_operators import docs_of, random_rows

# ---- whitening


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 5.0) for i, v in rows], "vec_id long, embedding array<float>, n int, x string, whitened double")


def whitened_plainly(rows, most=16):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in kept}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in fit])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = {}
    for i, row in x.items():
        apart = [n * a - s for a, s in zip(row, sums, strict=True)]
        out[i] = (sum(a * a for a in apart), np.array(apart) / n @ vectors / np.sqrt(values))
    return n, values / np.trace(v), out


def random_vectors(dims=24, n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1 + j) for j in range(dims)]) for i in range(n)]
    copies = [(n + i, rows[7][1]) for i in range(200)]
    bad = [(1000, None), (1001, []), (1002, [None] + [0.0] * (dims - 1)), (1003, [math.nan] * dims), (1004, [math.inf] + [0.0] * (dims - 1)), (1005, [1.0] * (dims - 1))]
    return rows + copies, bad


def test_whitening_equals_plain_covariance(spark):
    rows, bad = random_vectors()
    n, explained, want = whitened_plainly(rows)
    assert n == 300
    got = whitening.whiten(vectors_of(spark, rows + bad).repartition(7)).collect()
    assert len(got) == 16 * len(rows)
    sign = {}
    for r in got:
        deviation, w = want[r.vec_id]
        assert r.n == n and r.deviation == deviation and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        if abs(w[r.component - 1]) > 1e-6:
            s = sign.setdefault(r.component, math.copysign(1, r.whitened * w[r.component - 1]))
            assert s * r.whitened == pytest.approx(w[r.component - 1], rel=1e-6, abs=1e-9)


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    n, explained, want = whitened_plainly([(r.vec_id, r.embedding) for r in table.collect()])
    got = queries.op11_whitening(spark, DATA).collect()
    assert len(got) == 16 * len(want)
    for r in got:
        assert r.n == n and r.deviation == want[r.vec_id][0] and abs(r.whitened) == pytest.approx(abs(want[r.vec_id][1][r.component - 1]), rel=1e-6, abs=1e-8)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error <= 1e-4


def test_merging_in_any_order_gives_the_same_moments():
    r = np.random.default_rng(3)
    x = np.floor(r.normal(0, 50, (400, 6)) * [1, 1, 1, 10, 100, 0]).astype(np.int64) + 10**12
    whole = whitening.Moments.of(x)
    for cuts in ([1, 2, 399], [200], [50, 51, 52, 300]):
        parts = [whitening.Moments.of(p) for p in np.split(x, cuts)]
        r.shuffle(parts)
        out = whitening.Moments(0, [], np.zeros(0))
        for p in parts:
            out = out.merge(p)
        assert (out.n, out.sums) == (400, whole.sums) == (400, [int(s) for s in x.astype(object).sum(axis=0)])
        assert np.allclose(out.scatter, whole.scatter, rtol=1e-12)


def test_whitening_odd_tables(spark):
    bad = random_vectors(dims=3, n=8)[1]
    assert whitening.whiten(vectors_of(spark, [])).count() == 0 and whitening.whiten(vectors_of(spark, bad[:5])).count() == 0
    same = whitening.whiten(vectors_of(spark, [(i, [1.5, -2.0]) for i in (1, 1, None)])).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == sorted((i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 1, 0) for c in (1, 2))
    flat = whitening.whiten(vectors_of(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()
    assert all(r.identity_error < 1e-9 and (r.component == 1 or r.whitened == 0) for r in flat) and len(flat) == 27
    large = whitening.whiten(vectors_of(spark, [(i, [2.0**54 * (-1) ** i, float(i)]) for i in range(6)])).collect()
    assert len(large) == 12 and all(r.deviation is None for r in large)  # beyond a long


# ---- Merkle manifest


def plain_manifest(rows):
    """{row: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)} by walking whole lists."""

    def h(s):
        return hashlib.sha256(s.encode()).hexdigest()

    def leaf(r):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            a = i - i % 3
            yield nodes[a:i], nodes[i + 1 : a + 3]
            i //= 3

    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by_source[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for rank, s in enumerate(sources):
        for i, r in enumerate(by_source[s]):
            steps = [*path(trees[s], i), *path(top, rank)]
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf((*r[:4], text))
            for left, right in steps:
                node = h("".join(left) + node + "".join(right))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h("".join("".join(a + b) for a, b in steps)), node, node == top[-1][0]))
    return out


def manifest_rows(df):
    return sorted(map(repr, (tuple(r[:7]) for r in df.collect())))


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_whole_trees(spark, levels):
    r = random.Random(levels)
    rows = [(i, t, l, s) for i, t, l, s in random_rows(n=40)] + [(100 + i, f"line {i}\nline", "en", "hot") for i in range(130)]
    rows += [(400, "x\ny", "en", ""), (401, "x", None, "é"), (401, "x", None, "é"), (401, "a\nb", None, "é"), (402, "only", "en", "zz"), (403, "y" * 300_000 + "\n", "en", "=")]
    r.shuffle(rows)
    docs = docs_of(spark, rows).repartition(5)
    got = merkle.manifest(docs, found=merkle.without_line_breaks(), levels=levels)
    assert manifest_rows(got) == sorted(map(repr, plain_manifest([(i, s, l, len(t or ""), t) for i, t, l, s in rows])))


def test_manifest_of_sources_of_many_sizes(spark):
    rows = [(1000 * n + i, f"a\n{i}", "en", f"s{n}") for n in (1, 2, 3, 4, 9, 10, 27, 28, 82) for i in range(n)]
    assert manifest_rows(merkle.manifest(docs_of(spark, rows), found=merkle.without_line_breaks(), levels=2)) == sorted(map(repr, plain_manifest([(i, s, l, len(t), t) for i, t, l, s in rows])))
    one = [(5, "a\nb", "en", "s")]
    assert manifest_rows(merkle.manifest(docs_of(spark, one), found=merkle.without_line_breaks())) == sorted(map(repr, plain_manifest([(5, "s", "en", 3, "a\nb")])))


def test_manifest_finds_what_changed(spark):
    docs = docs_of(spark, [(i, f"text {i}", "en", "ab"[i % 2]) for i in range(50)])
    assert merkle.manifest(docs).filter("not verified").count() == 0
    changed = merkle.field_digest(*(F.concat("text", F.lit("!")) if f == "text" else F.col(f) for f in merkle.FIELDS))
    out = merkle.manifest(docs, found=F.when(F.col("doc_id") == 7, changed), proofs=True, fanout=4)
    assert [r.doc_id for r in out.filter("not verified").collect()] == [7]
    row = out.filter("doc_id = 8").first()
    assert hashlib.sha256(row.proof.encode()).hexdigest() == row.proof_sha256 and len(row.proof) % 64 == 0
    assert merkle.manifest(docs_of(spark, [])).count() == 0


def test_numbers_and_sizes_joined_by_shuffle(spark):
    nodes = spark.range(2000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("tree"), (F.col("id") * 7 % 2003).alias("o"))
    for limit in (0, 1 << 20):
        placed, trees = merkle.numbered(nodes, "tree", ["o"], broadcast_bytes=limit)
        rows = merkle.with_sizes(placed, trees, broadcast_bytes=limit).collect()
        assert len(rows) == 2000
        hot = sorted((r.o, r["index"], r.n) for r in rows if r.tree == "hot")
        assert [x[1] for x in hot] == list(range(len(hot))) and {x[2] for x in hot} == {len(hot)}
        assert {(r["index"], r.n) for r in rows if r.tree != "hot"} == {(0, 1)}


# ---- URL filter


def judged_plainly(url):
    word = lambda c: c.isalnum()
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = tail[: min([i for i, c in enumerate(tail) if c in "?#"], default=len(tail))]
    found = {}
    for kind, terms in (("strict", urlfilter.STRICT), ("soft", urlfilter.SOFT)):
        found[kind] = sorted(t for t in terms if any(low.startswith(t, i) and not (i and word(low[i - 1])) and not (i + len(t) < len(low) and word(low[i + len(t)])) for i in range(len(low))))
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
    verdict = rule.verdict if rule else "block" if found["strict"] or len(found["soft"]) >= 2 else "allow"
    return host, path, rule.host + rule.path if rule else None, verdict, found["strict"], found["soft"]


URLS = [
    None, "", "no scheme porn", "http://", "https://X.Example.ORG/es/1?a#b", "http://example.org/en/12", "http://sub.example.org/en/2", "http://notexample.org/es/", "http://org", "http://org/", "http://a.org?x=/", "http://b.com/fr/x", "http://b.com/de/casino",
    "http://b.com/en/", "http://b.com/Fr/", "http://b.com:80/fr/", "ftp://a://b/c", "http://casino.net/free", "http://casinos.net/free-bet5", "http://a.net/XXX", "http://a.net/xxxl", "http://a.net/axxx", "http://a.net/éxxx", "http://a.net/%20xxx%20", "http://a.net/free/free/FREE",
    "http://a.net/win-win?free", "http://com/fr/porn", "http://a.net/" + "y" * 200_000 + "/nsfw", "http://a.net/\nfree\nwin", "://", "x://y", "http://a.net#frag/porn", "http://..org/", "http://Example.Org/EN/1",
]


def pages_of(spark, urls):
    return spark.createDataFrame([(None if i == 3 else i, u, "<html>", "h", "p", "r", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, path string, rule string, verdict string")


def test_urls_judged_one_by_one(spark):
    got = urlfilter.judge_urls(pages_of(spark, URLS + URLS[:2]))
    want = [(None if i == 3 else i, *judged_plainly(u)) for i, u in enumerate(URLS + URLS[:2])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert urlfilter.judge_urls(pages_of(spark, [])).count() == 0
    assert urlfilter.judge_urls(pages_of(spark, URLS), rules=(), strict=(), soft=()).filter("verdict = 'block' or rule is not null").count() == 0


def test_terms_of_planted_hosts(spark):
    hosts = {"casino-win.example.net": "block", "cheap-pills.example.net": "block", "free-bets.example.net": "block", "free-software.example.net": "allow", "casinowin.example.net": "allow", "young-adult.example.net": "allow"}
    got = urlfilter.judge_urls(pages_of(spark, [f"https://www.{h}/en/1" for h in hosts]))
    assert [r.verdict for r in sorted(got.collect(), key=lambda r: list(hosts).index(r.host[4:]))] == list(hosts.values())


def test_verdicts_of_the_contract(spark):
    contract = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    assert [tuple(r) for r in urlfilter.RULES] == contract
    got = urlfilter.judge_urls(pages_of(spark, [f"http://www.{host}{path}x" for _, host, path in contract])).collect()
    assert sorted((r.verdict, r.rule) for r in got) == sorted((verdict, host + path) for verdict, host, path in contract)


def test_rules_longest_wins():
    table = urlfilter.RuleTable([urlfilter.Rule("block", "b.c", "/"), urlfilter.Rule("allow", "c", "/longer/"), urlfilter.Rule("block", "c", ""), urlfilter.Rule("allow", "b.c", "/x")])
    assert [getattr(table.find(h, p), "text", None) for h, p in (("a.b.c", "/longer/"), ("a.b.c", "/xy"), ("c", "/q"), ("d", "/"), ("", ""), ("bb.c", "/"))] == ["c/longer/", "b.c/x", "c", None, None, "c"]


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_url_filter"])
def test_new_queries_equal_sql(spark, name):
    check(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name], connect())


def test_sql_on_odd_rows(spark):
    c = connect()
    rows = [(i, t, l, s) for i, t, l, s in random_rows(n=30) if i is not None]
    docs = docs_of(spark, list({r[0]: r for r in rows}.values())).select("doc_id", "text", "lang", "source", "n_chars")
    c.register("odd_documents", docs.toPandas())
    check(merkle.manifest(docs, found=merkle.without_line_breaks()), oracles.MERKLE.replace("FROM documents", "FROM odd_documents"), c)
