"""Toxicity by compression distance.

Two zstandard raw-content dictionaries are trained: one on ordinary text, one
on the same background plus a keyword list: the words typical of toxic text by
document frequency.  Running toxic text in the dictionary was tried and tells
far less (README).  A window is one word between blanks; each is compressed with both dictionaries, and one
that the toxic dictionary makes shorter by half its length speaks for toxicity.
A logistic model, fitted on labelled rows that neither dictionary has seen,
turns the number and share of such windows into a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, columns_of, doc_bucket, pieces
from .langid import compressor
from .neardup import minhash, shingles
from .pieces import Generations

_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
#: A fixed run at the end of both dictionaries and of each window, so that a window is never too short to be matched.
TAIL = bytes(range(1, 9)) + bytes(range(14, 30))
LEVEL = 9
_TRIM = ".,;:!?\"'()[]|#*"


@dataclass
class ToxicityModel:
    """Dictionary contents and the weights of the logistic model."""

    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=lambda: [-3.0, 0.0, 0.0, 0.0])
    least_saved: int = 3

    def _compressors(self):
        if not hasattr(self, "_c"):
            self._c = (compressor(self.toxic + TAIL, LEVEL), compressor(self.ordinary + TAIL, LEVEL))
            self._saved = Generations(self._measure, 200_000)
        return self._c

    def _measure(self, word: str) -> int:
        """Bytes that the toxic dictionary saves on a window, 0 if under half of it."""
        word = word.strip(_TRIM)
        window = b" " + word.encode("utf-8", "replace") + b" " + TAIL
        toxic, ordinary = (len(c.compress(window)) for c in self._c)
        saved = ordinary - toxic
        return saved if saved >= self.least_saved and 2 * saved >= len(window) - len(TAIL) - 1 else 0

    def features(self, text: str | None) -> list[float]:
        """Windows with a saving (up to 6), the same for a thousand windows (log), whether there are two."""
        words = (text or "").lower().split()
        if not words or not self.toxic:
            return [0.0, 0.0, 0.0]
        self._compressors()
        n = sum(map(bool, map(self._saved.__getitem__, words)))
        return [float(min(n, 6)), math.log1p(1000 * n / len(words)), float(n >= 2)]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_c", "_saved")}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 100) -> list[float]:
    """Weights (constant first) by Newton steps, each halved until the penalised loss falls.

    Separable rows would drive plain steps to and fro; the penalty and the
    halving keep them in bounds.
    """
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    penalty = np.array([1e-6] + [ridge] * x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * v * v).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if now - new < 1e-9 * max(1.0, abs(now)):
            break
        w, now = w + size * step, new
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_each: int = 2500, sample_chars: int = 20_000, background: int = 100_000, typical: int = 10_000) -> ToxicityModel:
    """A model from a bounded sample of labelled rows.

    At most about ``sample_each`` rows of each label, the first by a hash of the
    id, with ``sample_chars`` characters each from a place set by the hash.  Three
    quarters fill the dictionaries, the others fit the logistic model.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return ToxicityModel()
    h = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    share = F.when(F.col("y") == 1, sample_each / counts[1]).otherwise(sample_each / counts[0])
    chosen = known.withColumn("h", h).filter(F.col("h") < share * 1_000_003)  # bounded by the sample size
    part = F.substring(text_col, F.pmod(F.col("h"), F.greatest(F.length(text_col) - sample_chars, F.lit(0)) + 1).cast("int") + 1, F.lit(sample_chars))
    got = docs.filter(F.col(text_col).isNotNull()).join(F.broadcast(chosen), docs[id_col] == chosen["id"]).select("id", "h", "y", part.alias("part"))
    rows = sorted((r["h"], r["id"], r["y"], r["part"]) for r in got.toLocalIterator())
    return fit([(y, t) for k, (_, _, y, t) in enumerate(rows) if k % 4], [(y, t) for k, (_, _, y, t) in enumerate(rows) if not k % 4], background, typical, counts[1] / (counts[0] + counts[1]))


def without_copies(rows: list[tuple[int, str]], hashes: int = 6) -> list[tuple[int, str]]:
    """Rows (label, text) of the sample without copies and near copies: they would make their own words look typical.

    A text that shares one of its first min-hashes with an earlier one goes.
    """
    seen, out = set(), []
    for y, text in rows:
        s = shingles(text)
        keys = set(enumerate(minhash(s)[:hashes].tolist())) if len(s) else {(-1, 0)}
        if not keys & seen:
            out.append((y, text))
        seen |= keys
    return out


def background_slice(text: str, chars: int = 2000) -> str:
    """``chars`` characters of a text, from a place set by its hash."""
    at = xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) % (max(0, len(text) - chars) + 1)
    return text[at : at + chars]


def fit(for_words: list[tuple[int, str]], for_weights: list[tuple[int, str]], background: int, typical: int, base_rate: float) -> ToxicityModel:
    """Dictionaries from the first rows (label, text), weights from the second."""
    for_words = without_copies(for_words)
    n, df = Counter(y for y, _ in for_words), (Counter(), Counter())
    for y, text in for_words:
        df[y].update({w.strip(_TRIM) for w in text.lower().split()} - {""})
    if not n[0] or not n[1]:
        return ToxicityModel()

    # words in far more toxic documents than ordinary ones, the strongest last
    gain, size, typical_words = [], 0, []
    for w, d in df[1].items():
        ratio = (d / (n[1] + 1)) / ((df[0][w] + 1) / (n[0] + 1))
        if d >= 3 and ratio >= 4:
            gain.append((d * math.log(ratio), w))
    for g, w in sorted(gain, reverse=True):
        if g < max(6.0, 0.04 * n[1]) or size > typical:
            break
        typical_words.append(w)
        size += len(w.encode()) + 1
    words = (" " + " ".join(reversed(typical_words)) + " ").encode("utf-8", "replace")
    common, size = [], 0
    for y, text in for_words:
        if y == 0 and size < background + len(words):
            common.append(" ".join(background_slice(text).lower().split()))
            size += len(common[-1].encode()) + 1
    base = " ".join(common).encode("utf-8", "replace")
    model = ToxicityModel(base[:background] + words, base[background : background + len(words)] + base[:background])
    x, y = np.array([model.features(t) for _, t in for_weights]), np.array([y for y, _ in for_weights], float)
    if len(set(y.tolist())) == 2:
        model.weights = _logistic(x, y)
        seen = float(y.mean())
        model.weights[0] += math.log(base_rate / (1 - base_rate)) - math.log(seen / (1 - seen))
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", parts: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each input row.

    Whole texts of any length are scored window by window.  Null and empty
    texts have no windows and get the model's base score; repeated rows score
    alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, held_out, texts = columns_of(batch, "doc_id", "held_out", "text")
            scores = [model.score(t) for t in texts]
            yield batch_of(_ARROW, [ids, held_out, scores, [int(s >= threshold) for s in scores]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(doc_bucket(F.col(id_col), parts) == held, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def learn_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 3, held: int = 1) -> DataFrame:
    """Train on labelled rows outside the held-out fold, then score every row."""
    seen = labels.filter(F.coalesce(doc_bucket(F.col(id_col), parts) != held, F.lit(False)))
    return score_documents(docs, train(docs, seen, id_col, text_col, label_col), id_col, text_col, parts, held)
