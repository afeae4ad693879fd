"""MinHash near-duplicate groups with sequential Bayesian verification.

A document is its set of five-word shingles.  Documents of equal sets are
folded into one representative first.  MinHash signatures are cut into bands;
documents that share a band meet in a bucket.  There signatures are compared
batch by batch, and a pair is pruned once the posterior probability that its
similarity reaches the threshold falls below the chosen miss probability.
Survivors are verified exactly on the full sets.

No bucket emits all its pairs.  A first round proposes a spanning forest of
each bucket, strongest pairs first.  A second round looks at every surviving
pair whose ends are still in different components, so no link that could
change a component is left out.  There a document is given as its difference
from a pivot, the smallest document it meets: for two documents with the same
pivot the exact intersection follows from the differences, and only pairs that
are linked, or have different pivots, leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, columns_of, cut, meet, pieces
from .pieces import Generations

WORDS = 5
BANDS, ROWS, BATCH = 25, 5, 25
HASHES = BANDS * ROWS

_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_PLACE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_MEASURED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_DELTAS = pa.schema([("rep", pa.int64()), ("pivot", pa.int64()), ("n_set", pa.int64()), ("n_pivot", pa.int64()), ("missing", pa.binary()), ("extra", pa.binary())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``WORDS`` words.

    ASCII letters are lower-cased; words end at ASCII white space.  Fewer words
    make one shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    if n < 1:
        return _mix((h * _PLACE[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    total = h[:n] * _PLACE[0]
    for k in range(1, WORDS):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(_mix(total))


def minhash(values: np.ndarray) -> np.ndarray:
    """``HASHES`` minima, one for each hash function."""
    x, least = (values >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (x[at : at + 2048, None] * _MULT + _ADD).min(axis=0), out=least)
    return least


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = np.arange(BANDS, dtype=np.uint64)
    for batch in pieces(batches, 500):
        out = []
        for doc_id, text_hash, text in zip(*columns_of(batch, "doc_id", "text_hash", "text"), strict=True):
            s = shingles(text)
            if not len(s):
                out.append((doc_id, text_hash, 0, None, None, None, None))
                continue
            least = minhash(s)
            bands = _mix((least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) + numbers)
            total, mixed = s.sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(s + np.uint64(1)))
            out.append((doc_id, text_hash, len(s), int(total.view(np.int64)), int(mixed.view(np.int64)), bands.view(np.int64), least.astype(np.uint8).tobytes()))
        if out:
            yield batch_of(_MEASURED, zip(*out, strict=True))


def least_matches(threshold: float, miss: float) -> list[int]:
    """least[n]: with fewer matches among n hashes, P(similarity >= threshold) is below ``miss``.

    With a uniform prior the posterior is Beta(k + 1, n - k + 1), whose upper
    tail at t equals the lower tail of Binomial(n + 1, t) up to k.
    """
    out = [0]
    for n in range(1, HASHES + 1):
        total, k = 0.0, 0
        while True:
            total += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
            if total >= miss:
                break
            k += 1
        out.append(k)
    return out


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of ``sig`` left after comparing batch after batch, and their matches."""
    k = np.zeros(len(i), np.int32)
    for at in range(0, HASHES, BATCH):
        k += (sig[i, at : at + BATCH] == sig[j, at : at + BATCH]).sum(axis=1, dtype=np.int32)
        ok = k >= least[at + BATCH]
        if not ok.all():
            i, j, k = i[ok], j[ok], k[ok]
    return i, j, k


def _forest(i: np.ndarray, j: np.ndarray, k: np.ndarray, size: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, most matches first."""
    parent, out = list(range(size)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for p in np.argsort(-k, kind="stable"):
        x, y = root(int(i[p])), root(int(j[p]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(i[p]), int(j[p])))
    return out


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows with equal (key, chunk) in sorted batches, as arrays by column."""
    held: dict[str, np.ndarray] | None = None
    for batch in pieces(batches, 4000):
        if not batch.num_rows:
            continue
        cols = {}
        for name in names:
            c = batch.column(batch.schema.get_field_index(name))
            if name in ("missing", "extra"):  # of any length
                cols[name] = np.fromiter(c.to_pylist(), object, batch.num_rows)
            elif pa.types.is_binary(c.type):
                raw = b"".join(c.to_pylist())
                cols[name] = np.frombuffer(raw, np.uint8).reshape(batch.num_rows, -1)
            else:
                cols[name] = c.to_numpy(zero_copy_only=False)
        if held is not None:
            cols = {n: np.concatenate([held[n], cols[n]]) for n in names}
        ends = np.flatnonzero((cols["key"][1:] != cols["key"][:-1]) | (cols["chunk"][1:] != cols["chunk"][:-1])) + 1
        at = 0
        for end in ends.tolist():
            yield {n: c[at:end] for n, c in cols.items()}
            at = end
        held = {n: c[at:] for n, c in cols.items()}
    if held is not None:
        yield held


def _out(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return batch_of(_PAIRS, zip(*found, strict=True) if found else [[], []])


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) from edges (a, b), by alternating large and small stars."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rays")).select("u", F.least("u", "m").alias("m"), "rays")
        large = cut(meet(both.filter("v > u"), least, ["u"], "rays").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        root = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rays"))
        small = meet(large, root, ["a"], "rays").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(root.select("a", F.col("m").alias("b"))).distinct())


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, miss: float = 1e-5, chunk: int = 400, wide_chunk: int = 1000) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, keeper for each input row.

    ``keeper`` marks the rows that stand for their component: those of its
    smallest id, and of several texts under that id the one with the smallest hash.
    """
    spark = docs.sparkSession
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    measured = cut(rows.mapInArrow(_measure, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>, sig binary"))
    able = measured.filter(F.col("s1").isNotNull() & F.col("doc_id").isNotNull())

    # equal sets fold into one node, before anything is joined
    equal = able.groupBy("s1", "s2").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("home"), F.min_by(F.struct("bands", "sig"), "doc_id").alias("marks"))
    nodes = cut(cut(equal).select(F.monotonically_increasing_id().alias("rep"), "s1", "s2", "copies", "home.doc_id", "home.text_hash", "marks.bands", "marks.sig"))

    # buckets with company
    in_band = nodes.select("rep", F.explode("bands").alias("key"))
    shared = cut(in_band.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lowest")).filter("n > 1"))
    low_bands = F.transform("bands", lambda v: F.substring(F.to_binary(F.lpad(F.hex(v), 16, "0"), F.lit("hex")), 5, 4))
    marks = nodes.select("rep", "sig", F.aggregate(low_bands, F.lit(b""), lambda acc, v: F.concat(acc, v)).alias("low"))
    company = cut(meet(in_band, shared, ["key"], "n"))
    seated = cut(company.drop("lowest").join(marks, "rep"))
    least = least_matches(percent / 100, miss)

    # texts of all nodes that may be compared
    wanted = nodes.join(company.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "text_hash")
    texts = cut(rows.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["rep"]).select("rep", "text"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for g in _groups(batches, ("key", "chunk", "rep", "sig")):
            n, rep = len(g["rep"]), g["rep"]
            if n > 1:
                i, j = np.triu_indices(n, 1)
                found += [(int(rep[x]), int(rep[y])) for x, y in _forest(*surviving(g["sig"], i, j, least), n)]
                if len(found) > 50_000:
                    yield _out(found)
                    found = []
        yield _out(found)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: dict[int, str] = {}
        sets = Generations(lambda i: shingles(text[i]), 400)
        for batch in pieces(batches, 500):
            found = []
            for a, b, x, y in zip(*columns_of(batch, "a", "b", "text_a", "text_b"), strict=True):
                text[a], text[b] = x, y
                s, t = sets[a], sets[b]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    found.append((a, b))
            text.clear()
            yield _out(found)

    def with_texts(pairs: DataFrame) -> DataFrame:
        """``pairs``, a written table of (a, b), with both texts; b may be the centre of many pairs."""
        x = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
        y = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
        return meet(pairs, y, ["b"]).join(x, "a")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return with_texts(pairs).mapInArrow(verify, "a long, b long")

    place = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / chunk)).cast("int").alias("chunk")
    sat = seated.select("key", place, "rep", "sig").repartition(n_parts, "key", "chunk").sortWithinPartitions("key", "chunk", "rep")
    tried = cut(sat.mapInArrow(propose, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    # several texts under one id are one document
    variants = cut(able.select("doc_id", "s1", "s2").distinct())
    several = variants.groupBy("doc_id").agg(F.count("*").alias("texts"), F.min(F.struct("s1", "s2")).alias("one")).filter("texts > 1")
    several = cut(meet(variants, cut(several), ["doc_id"], "texts"))
    of_set = lambda name: nodes.select("s1", "s2", F.col("rep").alias(name))
    same_id = several.join(of_set("a"), ["s1", "s2"]).select("a", F.col("one.s1").alias("s1"), F.col("one.s2").alias("s2")).distinct().join(of_set("b"), ["s1", "s2"]).select("a", "b")
    first = cut(connected(confirmed(tried).unionByName(same_id)))

    # each node's difference from its pivot
    pivot = cut(company.groupBy("rep").agg(F.min("lowest").alias("pivot")).select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
    deltas = cut(with_texts(pivot).mapInArrow(differ, "rep long, pivot long, n_set long, n_pivot long, missing binary, extra binary"))

    # buckets that still hold several components: blocks of rows outside the largest one meet blocks of all
    of = cut(seated.join(first, seated["rep"] == first["node"], "left").select("key", "n", "rep", "sig", "low", F.coalesce("component", "rep").alias("comp")))
    sizes = of.groupBy("key", "comp").agg(F.count("*").alias("size")).groupBy("key").agg(F.count("*").alias("n_comps"), F.max(F.struct("size", "comp")).alias("largest"), F.sum("size").alias("seats"))
    split = meet(of, cut(sizes.filter("n_comps > 1")), ["key"], "seats").withColumn("chunks", F.ceil(F.col("n") / wide_chunk).cast("int"))
    split = split.withColumn("blocks", F.ceil((F.col("n") - F.col("largest.size")) / wide_chunk).cast("int")).withColumn("minor", F.col("comp") != F.col("largest.comp"))
    spread = split.join(deltas, "rep")
    hashed = F.xxhash64("rep")
    asking = spread.filter("minor").withColumn("asks", F.lit(1)).withColumn("chunk", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.pmod(hashed, F.col("blocks")).cast("int") * F.col("chunks") + c)))
    asked = spread.withColumn("asks", F.lit(0)).withColumn("chunk", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b * F.col("chunks") + F.pmod(hashed, F.col("chunks")).cast("int"))))
    spread = asking.unionByName(asked).select("key", "chunk", "rep", "comp", F.col("minor").cast("int").alias("minor"), "asks", "sig", "low", "pivot", "n_set", "n_pivot", "missing", "extra")
    met = spread.repartition(n_parts, "key", "chunk").sortWithinPartitions("key", "chunk", "rep", "asks").mapInArrow(across(least, percent), "a long, b long")
    links = confirmed(cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")))
    ca, cb = first.select(F.col("node").alias("a"), F.col("component").alias("ca")), first.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    merged = cut(connected(links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))))
    m = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
    current = first.join(m, "component", "left").select("node", F.coalesce("root", "component").alias("component")).unionByName(merged.join(first.select("node"), "node", "left_anti"))

    # the smallest id of each component, for each node, then for each row
    of_node = cut(nodes.join(current, F.col("rep") == F.col("node"), "left").select("s1", "s2", "copies", "doc_id", "text_hash", F.coalesce("component", "rep").alias("comp")))
    lowest = of_node.groupBy("comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("size"))
    of_node = cut(meet(of_node, cut(lowest), ["comp"], "size").select("s1", "s2", "copies", "least"))
    linked = meet(able.select("doc_id", "text_hash", "n_shingles", "s1", "s2"), of_node, ["s1", "s2"], "copies")
    linked = linked.select("doc_id", "text_hash", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "text_hash") == F.col("least")).alias("keeper"))
    alone = measured.filter(F.col("s1").isNull() | F.col("doc_id").isNull()).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper"))
    # an id may stand for a component by one text and have others, even without words
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each input row.

    Documents are linked when 100 * intersection >= ``percent`` * union of their
    shingle sets; a component is all that can be reached.  ``kept`` marks rows
    whose id is the smallest of their component.  Null, empty and blank texts
    have no shingles and are linked with nothing; rows with a null id are
    returned unlinked, with a null component, and kept.  Rows repeated under
    one id are one document: each of their texts may link it.

    A pair at the threshold shares no band with probability
    (1 - 0.85^5)^25 < 1e-6; ``miss`` bounds what pruning adds.
    """
    out = components(docs, id_col, text_col, **options)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents a and their pivots b: places of the pivot's shingles that a lacks, and a's further shingles.

    A document less than half alike its pivot gets none: its difference would
    be as large as itself.
    """
    for batch in pieces(batches, 500):
        out = []
        for a, b, x, y in zip(*columns_of(batch, "a", "b", "text_a", "text_b"), strict=True):
            s, p = shingles(x), shingles(y)
            lacks = ~np.isin(p, s, assume_unique=True)
            both = len(p) - int(lacks.sum())
            if 2 * both >= len(s) + len(p) - both:
                out.append((a, b, len(s), len(p), np.flatnonzero(lacks).astype(np.uint32).tobytes(), np.setdiff1d(s, p, assume_unique=True).tobytes()))
            else:
                out.append((a, -1, len(s), 0, b"", b""))
        if out:
            yield batch_of(_DELTAS, zip(*out, strict=True))


def across(least: list[int], percent: int):
    """A function over sorted bucket rows that proposes pairs between components.

    For each row that asks, which lies outside its bucket's largest component: all
    rows asked that are of other components and survive pruning.  With the same
    pivot the link is decided here, else the pair is proposed.  A pair is looked
    at only in the first band it shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for g in _groups(batches, ("key", "chunk", "rep", "comp", "minor", "asks", "sig", "low", "pivot", "n_set", "n_pivot", "missing", "extra")):
            sig, rep, pivot, n_set, n_pivot = (g[c] for c in ("sig", "rep", "pivot", "n_set", "n_pivot"))
            low = g["low"].reshape(len(rep), BANDS, 4).view(">u4")[:, :, 0]
            band = int(np.flatnonzero(low[0] == (int(g["key"][0]) & 0xFFFFFFFF))[0])
            members, known = np.flatnonzero(g["asks"] == 0), {}

            def difference(i: int) -> tuple[int, frozenset]:
                if i not in known:
                    lacks = 0
                    for k in np.frombuffer(g["missing"][i], np.uint32).tolist():
                        lacks |= 1 << k
                    known[i] = (lacks, frozenset(np.frombuffer(g["extra"][i], np.uint64).tolist()))
                return known[i]

            for i in np.flatnonzero(g["asks"]).tolist():
                # a pair of two rows outside the largest component is looked at once: when the smaller one asks
                j = members[(g["comp"][members] != g["comp"][i]) & ((g["minor"][members] == 0) | (rep[members] > rep[i]))]
                if len(j):
                    _, j, _ = surviving(sig, np.full(len(j), i), j, least)
                    if len(j) and band:
                        j = j[~(low[j, :band] == low[i, :band]).any(axis=1)]
                    for y in j.tolist():
                        if pivot[i] >= 0 and pivot[y] == pivot[i]:
                            (lacks, extra), (lacks_y, extra_y) = difference(i), difference(y)
                            both = int(n_pivot[i]) - (lacks | lacks_y).bit_count() + len(extra & extra_y)
                            if 100 * both < percent * (int(n_set[i]) + int(n_set[y]) - both):
                                continue
                        found.append((int(rep[i]), int(rep[y])))
            if len(found) > 50_000:
                yield _out(found)
                found = []
        yield _out(found)

    return run


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicates, with all columns.

    It is the row with the smallest id, of several texts under that id the one with the
    smallest hash, and one of several equal rows.  Rows without shingles or id all stay.
    """
    found = cut(components(docs, id_col, text_col, **options))
    linked = found.filter("n_shingles > 0 and doc_id is not null")
    once = linked.groupBy("doc_id", "text_hash").agg(F.bool_or("keeper").alias("keeper"), F.count("*").alias("n")).filter("n > 1 or not keeper")
    once = cut(once)
    rows = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc")[id_col].cast("long").alias("doc_id"), F.xxhash64(F.col("doc")[text_col]).alias("text_hash"))
    single = rows.join(once, ["doc_id", "text_hash"], "left_anti")
    repeated = rows.join(once.filter("keeper").select("doc_id", "text_hash"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return single.select("doc.*").unionByName(repeated.select("doc.*"))
