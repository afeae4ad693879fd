"""Merkle manifest of a dataset: a tree of digests for each source, and one over the sources.

A leaf is the digest of a document's fields.  Leaves of a source, numbered in
the order of their ids, are cut into blocks aligned to a power of the fanout.
A block is one row that holds its digests as one run of 64-byte hex strings, so
a task sees a numpy matrix: each level is the matrix reshaped by the fanout and
hashed row by row.  Block roots are the leaves of the next round, until each
source has one; the way back down gives every block the siblings above it, and
every leaf finds its own by index arithmetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, bytes_within, columns_of, cut, doc_bucket, meet

HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """Lowercase hex sha256 of the parts in a row."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field_digest(*fields: Column) -> Column:
    """Digest of fields, each ``-`` if null, else its UTF-8 length in bytes, a colon and its value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def matrix(data: bytes) -> np.ndarray:
    """Digests in a row of bytes as a vector of 64-byte items."""
    return np.frombuffer(data, dtype=f"S{HEX}")


def levels_of(data: bytes, levels: int, fanout: int) -> list[np.ndarray]:
    """The leaves and each level above them, ``levels`` times; a run of fewer than ``fanout``, even of one, is hashed as it is."""
    out = [matrix(data)]
    for _ in range(levels):
        below = out[-1]
        whole = len(below) // fanout
        rows = below[: whole * fanout].reshape(whole, fanout)
        up = [digest(row.tobytes()) for row in rows]
        if whole * fanout < len(below):
            up.append(digest(below[whole * fanout :].tobytes()))
        out.append(np.array(up, dtype=f"S{HEX}"))
    return out


def siblings(tree: list[np.ndarray], index: int, fanout: int) -> list[bytes]:
    """For each level but the top one, the others of the run that holds the node above leaf ``index``, left to right."""
    out = []
    for nodes in tree[:-1]:
        first = index - index % fanout
        out.append(nodes[first:index].tobytes() + nodes[index + 1 : first + fanout].tobytes())
        index //= fanout
    return out


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def fold(node: bytes, proof: bytes, index: int, n: int, fanout: int) -> tuple[bytes, int]:
    """Root over leaf ``node``, ``index`` of ``n``, with the siblings at the start of ``proof``; and how many bytes of it were used."""
    at = 0
    while n > 1:
        place = index % fanout
        others = min(fanout, n - (index - place)) - 1
        left, right = at + place * HEX, at + others * HEX
        node = digest(proof[at:left], node, proof[left:right])
        at, index, n = right, index // fanout, -(-n // fanout)
    return node, at


def numbered(nodes: DataFrame, tree: str, order: list[str], broadcast_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``index``, (tree, n)): the place of each row, from 0, among those of its tree, and the size of each tree.

    ``tree`` is never null.  Rows are sorted once by range of tree and order and
    written with their place in the task; only counts for each task and tree
    are summed up, so a tree with most of the rows is spread over many tasks.
    """
    at = cut(nodes.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    runs = cut(at.groupBy(part.alias("part"), tree).agg(F.min("at").alias("first"), F.count("*").alias("run")))
    earlier = F.sum("run").over(Window.partitionBy(tree).orderBy("part")) - F.col("run")
    starts = cut(runs.select("part", tree, "first", earlier.alias("earlier")))
    if bytes_within(starts, broadcast_bytes):
        starts = F.broadcast(starts)
    index = F.col("at") - F.col("first") + F.col("earlier")
    return at.withColumn("part", part).join(starts, ["part", tree]).withColumn("index", index.cast("long")).drop("part", "at", "first", "earlier"), runs.groupBy(tree).agg(F.sum("run").alias("n"))


def climb(nodes: DataFrame, fanout: int, levels: int, most: int) -> list[DataFrame]:
    """Rounds of block rows (tree, index, n, levels, digests, held, digest), written, from (tree, index, n, held).

    ``n`` is the size of a node's tree, ``most`` that of the largest, and ``held``
    a struct with the node's ``digest``.  Each round goes up ``levels`` levels, or
    what is left to the root of the tree; in the last one each tree has one row,
    and its digest is the root.  A block's ``n`` is the number of blocks of its tree.
    """
    size, rounds = fanout**levels, []
    while True:
        held = F.transform(F.array_sort(F.collect_list(F.struct("index", "held"))), lambda x: x["held"])
        steps = sum((F.when(F.col("n") > F.lit(fanout**k), 1).otherwise(0) for k in range(levels)), F.lit(0))
        blocks = nodes.groupBy("tree", "n", F.expr(f"index div {size}").alias("block")).agg(held.alias("held"))
        digests = F.array_join(F.transform("held", lambda x: x["digest"]), "").cast("binary")
        blocks = blocks.select("tree", F.col("block").alias("index"), F.ceil(F.col("n") / size).cast("long").alias("n"), steps.alias("levels"), digests.alias("digests"), "held")

        def with_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                roots = [levels_of(d, k, fanout)[-1][0].decode() for d, k in zip(*columns_of(batch, "digests", "levels"), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, "digest"])

        rounds.append(cut(blocks.mapInArrow(with_root, T.StructType([*blocks.schema.fields, T.StructField("digest", T.StringType())]))))
        most = -(-most // size)
        if most <= 1:
            return rounds
        nodes = rounds[-1].select("tree", "index", "n", F.struct("digest").alias("held"))


def descend(rounds: list[DataFrame], above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``above`` for what lies below the blocks of all ``rounds``.

    It has (tree, index, proof) and further columns: ``proof`` are the siblings
    from the block's root upwards, to which each step down puts those inside the
    block in front.  Blocks and ``above`` meet by a key that each has once.
    """
    for blocks in reversed(rounds):
        rows = blocks.select("tree", "index", "levels", "digests").join(above, ["tree", "index"])
        names = [c for c in above.columns if c not in ("tree", "index", "proof")]

        def spread(batches: Iterator[pa.RecordBatch], names: list[str] = names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                digests, steps, indexes, proofs = columns_of(batch, "digests", "levels", "index", "proof")
                for row in range(batch.num_rows):
                    tree = levels_of(digests[row], steps[row], fanout)
                    n, first = len(tree[0]), indexes[row] * fanout**levels
                    inside = [b"".join(siblings(tree, i, fanout)).decode() + proofs[row] for i in range(n)]
                    same = batch.select(["tree", *names]).take(pa.array([row] * n))
                    yield pa.RecordBatch.from_arrays([same.column(0), pa.array(range(first, first + n), pa.int64()), pa.array(inside), *same.columns[1:]], names=["tree", "index", "proof", *names])

        above = rows.mapInArrow(spread, above.select("tree", "index", "proof", *names).schema)
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, found: Column | None = None, fanout: int = 3, levels: int = 6, proofs: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (and ``proof``, if asked for) for each input row.

    ``leaf`` is the digest of ``fields``; ``found`` is the digest to verify against
    the manifest, of the document as it is now (the leaf itself if not given or
    null).  Each source's leaves ascend by id and every ``fanout`` of them become
    their digest, level by level, up to ``subroot``; sources, null first, then
    by bytes, likewise to ``root``.  ``proof`` has the siblings of the path, one
    after the other.  ``folded_root`` is the root that ``found`` and the proof
    give, ``verified`` whether it is ``root``.

    Rows with one id are ordered by leaf; null ids come first; a lone leaf is
    its subroot; an empty table gives an empty result.  Texts are read once;
    blocks of ``fanout ** levels`` leaves are the largest unit of work, so a
    source with most of the rows is spread over many tasks.
    """
    result = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof string" * proofs
    leaf = field_digest(*map(F.col, fields))
    leaves = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("tree"), leaf.alias("digest"), (F.lit(None).cast("string") if found is None else found).alias("found"))
    leaves = cut(leaves.withColumn("row", F.monotonically_increasing_id()))
    placed, trees = numbered(leaves, "tree", ["doc_id", "digest", "row"])
    trees = cut(trees)
    most = trees.agg(F.max("n")).first()[0]
    if not most:
        return docs.sparkSession.createDataFrame([], result)
    held = F.struct("digest", "doc_id", F.when(F.col("found") != F.col("digest"), F.col("found")).alias("found"))
    placed = with_sizes(placed.select("tree", "index", held.alias("held")), trees)
    rounds = climb(placed, fanout, levels, most)

    # the tree over the sources
    subroots = cut(rounds[-1].select(F.lit("").alias("top"), "tree", "digest"))
    sources = subroots.count()
    ranked = numbered(subroots, "top", ["tree"])[0].select(F.lit("").alias("tree"), F.col("index"), F.lit(sources).cast("long").alias("n"), F.struct("digest", F.col("tree").alias("source")).alias("held"))
    upper = climb(ranked, fanout, levels, sources)
    root = upper[-1].first()["digest"]
    ranks = descend(upper, upper[-1].select("tree", "index", F.lit("").alias("proof")), fanout, levels)
    tops = ranks.select(F.col("index").alias("rank"), "proof").join(ranked.select(F.col("index").alias("rank"), F.col("held.source").alias("tree"), F.col("held.digest").alias("subroot")), "rank")
    above = tops.join(trees.withColumnRenamed("n", "leaves"), "tree").select("tree", F.lit(0).cast("long").alias("index"), "proof", "subroot", "rank", "leaves")
    above = descend(rounds[1:], above, fanout, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = fanout**levels
        for batch in batches:
            for row in range(batch.num_rows):
                digests, steps, block, above, subroot, rank, n, held = (batch.column(c)[row].as_py() for c in ("digests", "levels", "index", "proof", "subroot", "rank", "leaves", "held"))
                tree, above, out = levels_of(digests, steps, fanout), above.encode(), []
                for i, x in enumerate(held):
                    proof = b"".join(siblings(tree, i, fanout)) + above
                    node, used = fold((x["found"] or x["digest"]).encode(), proof, block * size + i, n, fanout)
                    folded = fold(node, proof[used:], rank, sources, fanout)[0].decode()
                    out.append((x["doc_id"], x["digest"], subroot, root, digest(proof).decode(), folded, folded == root) + ((proof.decode(),) if proofs else ()))
                yield batch_of(schema, zip(*out, strict=True))

    schema = pa.schema([(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_()}.get(c.split()[1], pa.string())) for c in result.split(", ")])
    return rounds[0].select("tree", "index", "levels", "digests", "held").join(above, ["tree", "index"]).mapInArrow(run, result)


def with_sizes(nodes: DataFrame, trees: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``nodes`` with ``n``, the size of their tree; ``trees`` is written and goes to every task if small."""
    return nodes.join(F.broadcast(trees), "tree") if bytes_within(trees, broadcast_bytes) else meet(nodes, trees, ["tree"], "n")


def without_line_breaks(id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """Digest of documents in whose text every line break was deleted, where 2 divides the id's crc32; nulls stay."""
    text = F.when(doc_bucket(F.col(id_col), 2) == 0, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
    return field_digest(*(text if f == text_col else F.col(f) for f in fields))
