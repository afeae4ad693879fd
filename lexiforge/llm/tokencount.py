"""Token counts by distinct pre-token.

Pre-tokens are counted per document, the pieces of each distinct pre-token are
counted once in the whole corpus, and the two are joined and summed; ids are
never built.  The most frequent pre-tokens form a table of bounded size that
goes to every task, so that only rare pre-tokens are shuffled to the join.  Long
pre-tokens are known by a hash, so a common one is in the table like any other.
"""

from __future__ import annotations

import functools
import json
import math
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batch_of, columns_of, cut, pieces

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_find = regex.compile(PATTERN).findall
_WORDS = pa.schema([("word", pa.string()), ("freq", pa.int64())])
_COUNTS = pa.schema([("key", pa.string()), ("freq", pa.int64()), ("n_pieces", pa.int64())])
_ROWS = pa.schema([("row", pa.int64()), ("part", pa.string()), ("times", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64())])


#: A pre-token of more characters is known by its hash.
KEY_CHARS = 24


def key_of(word: str) -> str:
    """The pre-token, or a 128-bit hash of a long one; a hash is longer than any pre-token that stands for itself."""
    return word if len(word) <= KEY_CHARS else xxhash.xxh3_128_hexdigest(word.encode("utf-8", "surrogatepass"))


def check_settings(tokenizer: bytes) -> None:
    """Raise if the tokenizer splits or normalises texts in another way than implemented here."""
    t = json.loads(tokenizer)
    split, plain = t.get("pre_tokenizer") or {}, ("single_word", "lstrip", "rstrip", "normalized")
    if t.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or t["model"].get("dropout") or any(a.get(k) for a in t["added_tokens"] for k in plain):
        raise ValueError("only byte-level tokenizers without normaliser, blank in front or stripping added tokens are implemented")


def splitter(tokenizer: bytes):
    """text -> (pre-tokens, added tokens met) as the tokenizer splits a text by default."""
    added = [t["content"] for t in json.loads(tokenizer)["added_tokens"]]
    special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def split(text: str) -> tuple[list[str], int]:
        if special is None or special.search(text) is None:
            return _find(text), 0
        parts = special.split(text)
        return [w for p in parts for w in _find(p)], len(parts) - 1

    return split


def pretoken_frequencies(rows: DataFrame, tokenizer: bytes, memory_words: int = 100_000) -> DataFrame:
    """word, freq: each distinct pre-token of the corpus with its number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(tokenizer), Counter()
        for batch in pieces(batches, 100):
            for text in columns_of(batch, "text")[0]:
                if text:
                    seen.update(split(text)[0])
            if len(seen) > memory_words:
                yield batch_of(_WORDS, [list(seen), list(seen.values())])
                seen.clear()
        yield batch_of(_WORDS, [list(seen), list(seen.values())])

    return rows.select("text").mapInArrow(run, "word string, freq long").groupBy("word").agg(F.sum("freq").alias("freq"))


@functools.lru_cache(maxsize=1)
def model_of(tokenizer: bytes) -> Tokenizer:
    """The tokenizer, built once in each Python worker; its threads would each hold memory of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = Tokenizer.from_str(tokenizer.decode())
    model.encode_special_tokens = True
    return model


def count_pieces(words: DataFrame, tokenizer: bytes) -> DataFrame:
    """key, freq, n_pieces: the pieces of each distinct pre-token, counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(tokenizer)
        for batch in pieces(batches, 2000):
            texts, freq = columns_of(batch, "word", "freq")
            yield batch_of(_COUNTS, [list(map(key_of, texts)), freq, [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]])

    return words.mapInArrow(run, "key string, freq long, n_pieces long")


def most_frequent(counts: DataFrame, most: int, steps: int = 16) -> DataFrame:
    """The rows of ``counts`` above the least frequency that leaves at most ``most`` of them.

    Frequencies are told apart to a sixteenth of a doubling, so a histogram of some
    hundred rows says where the limit is.
    """
    level = F.floor(F.log2("freq") * steps)
    found, total = math.inf, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > most:
            break
        found = r["level"]
    return counts.filter(level >= found) if total else counts


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, head_words: int = 150_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each input row.

    Null texts count as empty: 0 bytes, 0 tokens.  Added special tokens inside
    a text count as one token each, as the tokenizer's default has it.  The
    table sent to every task holds at most ``head_words`` keys, the most frequent
    ones, each of at most 32 characters; all others meet their counts in a
    shuffled join, where none has over 1 / ``head_words`` of all pre-tokens.
    Repeated rows each get their own output row.
    """
    with open(tokenizer_path, "rb") as f:
        tokenizer = f.read()
    check_settings(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = cut(count_pieces(pretoken_frequencies(rows, tokenizer), tokenizer))
    top = most_frequent(counts, head_words).select("key", "n_pieces")
    head = docs.sparkSession.sparkContext.broadcast({r["key"]: r["n_pieces"] for r in top.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = splitter(tokenizer), head.value
        for batch in pieces(batches, 200):
            out: list[tuple] = []
            for row, doc_id, text in zip(*columns_of(batch, "row", "doc_id", "text"), strict=True):
                words, total = split(text or "")
                for word, n in Counter(words).items():
                    key = key_of(word)
                    size = known.get(key)
                    if size is None:
                        out.append((row, key, n, None, None, None))
                    else:
                        total += n * size
                out.append((row, None, None, doc_id, len((text or "").encode()), total))
            yield batch_of(_ROWS, zip(*out, strict=True))

    found = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, part string, times long, doc_id long, n_bytes long, n_known long")
    # the row of each document gets a key of its own that no pre-token has
    keyed = found.withColumn("own", F.when(F.col("part").isNull(), F.col("row")).otherwise(F.lit(-1))).withColumn("part", F.coalesce("part", F.lit("")))
    sizes = counts.select(F.col("key").alias("part"), F.lit(-1).cast("long").alias("own"), "n_pieces")
    total = keyed.join(sizes, ["own", "part"], "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_bytes").alias("n_bytes"),
        (F.max("n_known") + F.coalesce(F.sum(F.col("times") * F.col("n_pieces")), F.lit(0))).alias("n_tokens"),
    )
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
