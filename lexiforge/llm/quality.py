"""Quality rules: text statistics and cross-document line frequency.

Every line of a document is normalised (lower case, digits to 0, white space
collapsed) and hashed.  For each host the distinct documents holding a line are
counted; lines above the limits are removed, and a document of which too little
is left is rejected.  Documents of equal text count as one: copies are the
near-duplicate stage's business, not boilerplate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, columns_of, cut, meet, pieces

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_DIGITS = re.compile(r"[0-9]")

_FIELDS = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:long>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("lines", pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())])))]
)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_hash(line: str) -> int:
    """64-bit hash of the normalised line."""
    return _signed(xxhash.xxh64_intdigest(" ".join(_DIGITS.sub("0", line.lower()).split())))


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found at least twice in ``words``."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total = end = 0
    for at, window in enumerate(windows):
        if window in often:
            total += at + 3 - max(at, end)
            end = at + 3
    return total


def text_stats(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, [(line hash, words), ...])."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, again, lines = set(), 0, []
    for line in text.split("\n"):
        if n := len(line.encode("utf-8", "surrogatepass").split()):
            again += line in seen
            seen.add(line)
            lines.append({"h": line_hash(line), "w": n})
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        again,
        repeated_words(words),
        lines,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        ids, hosts, hashes, texts = columns_of(batch, "doc_id", "host", "text_hash", "text")
        yield batch_of(_ARROW, [ids, hosts, hashes, *zip(*map(text_stats, texts), strict=True)])


def _base_failed(min_words: int = 50, max_repeat_percent: int = 50, **_) -> Column:
    n = F.col("n_words")
    return (n < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * n)


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host (with a mark, so that a null host is a host of its own), text_hash, text."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.col(text_col).alias("text"),
    )


def common_lines(lines: DataFrame, texts: DataFrame, limit_docs: int = 1000, limit_share: float = 0.10, least_docs: int = 3) -> DataFrame:
    """host, h of the lines above the limits, from lines (host, h, text_hash) and texts (host, text_hash).

    A line is common on its host if more than ``limit_docs`` distinct documents
    hold it, or more than ``least_docs`` and more than ``limit_share`` of the
    host's.  Up to ``limit_docs`` / ``limit_share`` documents the share decides,
    beyond that the number.
    """
    # exact copies are folded before counting, so a group of copies counts once
    per_line = lines.select("host", "h", "text_hash").distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min(least_docs, limit_docs))
    per_host = texts.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    return per_line.join(per_host, "host").filter((F.col("n_docs") > limit_docs) | ((F.col("n_docs") > least_docs) & (F.col("n_docs") > F.col("n_host") * limit_share))).select("host", "h")


def judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_left: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50, **limits) -> DataFrame:
    """doc_id, host, text_hash, the statistics, base_failed, kept, n_common_words, n_common_lines and gone (hashes of the common lines) for each row of ``docs``."""
    rows = _rows(docs, id_col, text_col, host_col)
    stats = cut(rows.mapInArrow(_measure, _FIELDS).withColumn("row", F.monotonically_increasing_id()))
    lines = stats.select("row", "host", "text_hash", F.explode("lines").alias("line")).select("row", "host", "text_hash", "line.h", "line.w")
    met = meet(lines, cut(common_lines(lines, stats, **limits)), ["host", "h"])
    removed = met.groupBy("row").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.collect_set("h").alias("gone"))
    n, w, failed = F.col("n_words"), F.coalesce("w", F.lit(0)), _base_failed(min_words, max_repeat_percent)
    return stats.drop("lines").join(removed, "row", "left").select(
        *[c for c in stats.columns if c not in ("row", "lines")],
        failed.alias("base_failed"),
        (~failed & (n - w >= n * min_left)).alias("kept"),
        w.alias("n_common_words"),
        F.coalesce("n", F.lit(0)).alias("n_common_lines"),
        F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"),
    )


def line_frequency_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """One row per input row with its statistics and whether it is kept.

    ``kept`` is false if the base rules fail (fewer than ``min_words`` words, or
    more than ``max_repeat_percent`` % of the words repeated), or if the lines
    left after removing common ones (``common_lines``) hold less than
    ``min_left`` of the words.

    Null or empty texts have zero words and fail the base rules; null hosts
    form one host; repeated rows are judged alike, each with its own output
    row, and count as one document.  An empty table gives an empty result.
    """
    return judged(docs, id_col, text_col, host_col, **options).drop("host", "gone")


def without_lines(text: str | None, gone: set[int]) -> str | None:
    """The text without the lines whose hash is in ``gone``; blank lines stay."""
    if text is None or not gone:
        return text
    return "\n".join(x for x in text.split("\n") if not x.encode("utf-8", "surrogatepass").split() or line_hash(x) not in gone)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces([batch]):
            texts, sets = columns_of(part, "text", "gone")
            new = pa.array([without_lines(t, set(g)) for t, g in zip(texts, sets, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc")), new], names=["doc", "text"])


def remove_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their texts without common lines, all columns kept.

    Rejected are the rows for which ``line_frequency_rules`` says so; the
    other lines stay as they are.  Rows repeated with one id, host and text are
    kept or dropped together.
    """
    kept = judged(docs, id_col, text_col, host_col, **options).filter("kept").select("doc_id", "host", "text_hash", "gone").dropDuplicates(["doc_id", "host", "text_hash"]).alias("k")
    whole = docs.select(F.struct("*").alias("doc"))
    doc = F.col("doc")
    rows = whole.select("doc", doc[text_col].alias("text"), doc[id_col].cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), doc[host_col].cast("string")), F.lit("")).alias("of")).alias("r")
    same = F.col("r.id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.of") == F.col("k.host")) & (F.xxhash64("r.text") == F.col("k.text_hash"))
    schema = rows.select("doc", "text").schema
    out = rows.join(kept, same).select("doc", "r.text", "gone").mapInArrow(_strip, schema)
    return out.select(*[(F.col("text") if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])
