"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled from a bounded
sample of labelled text.  A text is cut into blocks, each block is compressed
with every dictionary, and the language with the smallest total wins.  When
the margin to the runner-up is narrow the answer is marked as rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, columns_of, doc_bucket, pieces

LEVEL = 7
_LETTER = regex.compile(r"\p{L}")
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])


def compressor(content: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    """A compressor with ``content`` as its raw dictionary and no frame extras."""
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)


def train(docs: DataFrame, text_col: str, label_col: str, docs_per_language: int = 400, slice_chars: int = 600, dict_bytes: int = 110_000) -> dict[str, bytes]:
    """Dictionary content by label value.

    The sample is bounded: about ``docs_per_language`` labelled rows of each
    value, the first by a hash of the text, one slice of ``slice_chars`` from
    each (its place also set by the hash), ``dict_bytes`` in all.
    """
    rows = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * docs_per_language / n))])
    h = F.pmod(F.xxhash64("text"), F.lit(1_000_003))
    room = F.greatest(F.length("text") - slice_chars, F.lit(0)) + 1
    taken = rows.filter(h < share[F.col("label")] * 1_000_003).select("label", h.alias("h"), F.substring("text", F.pmod(F.xxhash64("text"), room).cast("int") + 1, F.lit(slice_chars)).alias("part")).distinct()
    out: dict[str, bytes] = {}
    for r in sorted(taken.collect(), key=lambda r: (r["label"], r["h"], r["part"])):
        if len(got := out.get(r["label"], b"")) < dict_bytes:
            out[r["label"]] = got + r["part"].lower().encode("utf-8", "replace") + b"\n"
    return {k: v[:dict_bytes] for k, v in sorted(out.items())}


class Classifier:
    """Languages by total compressed length over all blocks of a text."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = 1024, temperature: float = 3.0, min_margin: float = 0.01):
        self.languages = list(dictionaries)
        self.compressors = [compressor(dictionaries[k]) for k in self.languages]
        self.block, self.temperature, self.min_margin = block, temperature, min_margin

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language or und, score, relative margin, rejected)."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, 0.0, True
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        sizes = [sum(map(len, map(c.compress, blocks))) for c in self.compressors]
        best = min(sizes)
        first = sizes.index(best)
        rest = sizes[:first] + sizes[first + 1 :]
        score = 1 / (1 + sum(math.exp(-min(700.0, (s - best) / self.temperature)) for s in rest))
        margin = (min(rest) - best) / min(rest) if rest else 1.0
        return self.languages[first], score, margin, margin < self.min_margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", parts: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for each input row.

    ``lang_pred`` is the nearest language even where ``rejected`` says that the
    margin is too narrow to rely on it; null, empty and letterless texts give
    ``und`` with score 0.  Ties go to the first language by name.  Whole texts
    of any length are scored, block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, **options)
        for batch in pieces(batches):
            ids, held_out, texts = columns_of(batch, "doc_id", "held_out", "text")
            yield batch_of(_ARROW, [ids, held_out, *zip(*map(model.predict, texts), strict=True)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(doc_bucket(F.col(id_col), parts) == held, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def learn_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2) -> DataFrame:
    """Train on the rows outside the held-out fold, then classify every row."""
    seen = docs.filter(F.coalesce(doc_bucket(F.col(id_col), parts) != held, F.lit(False)))
    return identify(docs, train(seen, text_col, lang_col), id_col, text_col, parts, held)
