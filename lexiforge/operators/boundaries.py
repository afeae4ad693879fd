"""Sentence ends in text without signs: an averaged perceptron over hashed pieces of the words around each gap.

It learns from texts that have signs: these say where sentences end, and are
then taken away.  Tasks learn on their own documents from common weights, which
are averaged after each round.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import PUNCT, SENTENCE_END

#: Number of weights; pieces of words share them by hash.
SIZE = 1 << 16
#: A unit is a word between blanks and signs, or one ideograph or kana.
UNIT = re.compile(f"[一-鿿㐀-䶿぀-ヿ]|[^\\s一-鿿㐀-䶿぀-ヿ{PUNCT}]+")
END = re.compile(f"[.{SENTENCE_END}]")


def units_of(text: str) -> tuple[list[tuple[int, int]], list[bool]]:
    """Spans of the units of a text, and for each gap between two whether an end sign stands in it."""
    spans = [m.span() for m in UNIT.finditer(text)]
    return spans, [bool(END.search(text, a[1], b[0])) for a, b in zip(spans, spans[1:])]


def pieces_of(words: list[str], gap: int) -> list[int]:
    """Places of the weights for the gap after ``words[gap]``."""
    left, right = words[gap], words[gap + 1]
    before = words[gap - 1] if gap else ""
    after = words[gap + 2] if gap + 2 < len(words) else ""
    named = (
        "b", f"l{left}", f"r{right}", f"e{left[-3:]}", f"f{left[-2:]}", f"s{right[:3]}", f"t{right[:2]}", f"p{left[-2:]}|{right[:2]}", f"w{left}|{right}",
        f"u{before}|{left}", f"v{right}|{after}", f"c{right[:1].isupper():d}{left[:1].isupper():d}", f"n{min(len(left), 4)}{min(len(right), 4)}",
    )
    return [zlib.crc32(x.encode()) % SIZE for x in named]


@dataclass
class BoundaryModel:
    weights: np.ndarray

    def ends(self, words: list[str]) -> list[bool]:
        """For each gap whether a sentence ends there."""
        return [self.weights[pieces_of(words, i)].sum() > 0 for i in range(len(words) - 1)]

    def split(self, text: str | None) -> list[str]:
        """Sentences of a text, as they stand in it; signs that are there count too."""
        spans, marked = units_of(text or "")
        if not spans:
            return []
        out, first = [], spans[0][0]
        for i, end in enumerate(self.ends([text[a:b] for a, b in spans])):
            if end or marked[i]:
                out.append(text[first : spans[i + 1][0]].strip())
                first = spans[i + 1][0]
        return [*out, text[first:].strip()]

    def sentences(self, text: Column) -> Column:
        """The sentences of a column; null has none.  Fits wherever a splitter is asked for."""
        model = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([model.split(t) for t in texts], dtype=object)

        return F.pandas_udf(run, "array<string>")(text)


def train(docs: DataFrame, text_col: str = "text", rounds: int = 4, most: int = 20_000, tasks: int = 8) -> BoundaryModel:
    """A model learnt from texts with signs: at most ``most`` of them, the first ones by a hash of the text.

    In each round a task goes over its texts once and corrects the weights where
    they are wrong; the averages over its steps are averaged over the tasks, by
    their numbers of gaps.  Texts without two units teach nothing; without any
    the model finds no ends.
    """
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null").orderBy(F.xxhash64("text"), "text").limit(most).repartition(tasks, F.xxhash64("text")).cache()
    model = BoundaryModel(np.zeros(SIZE))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, summed, at, seen = start.weights.copy(), np.zeros(SIZE), np.zeros(SIZE, np.int64), 0
        for f in frames:
            for text in f["text"]:
                spans, marked = units_of(text)
                words = [text[a:b] for a, b in spans]
                for i, end in enumerate(marked):
                    seen += 1
                    p = pieces_of(words, i)
                    if (w[p].sum() > 0) != end:
                        for k in p:  # the sum over all steps is brought up to date only where weights change
                            summed[k] += w[k] * (seen - at[k])
                            at[k] = seen
                            w[k] += 1.0 if end else -1.0
        if seen:
            summed += w * (seen - at)
            yield pd.DataFrame({"gaps": [seen], "summed": [summed.tobytes()]})

    try:
        for _ in range(rounds):
            start = model
            parts = texts.mapInPandas(learn, "gaps long, summed binary").rdd.map(lambda r: (r.gaps, np.frombuffer(bytes(r.summed))))
            gaps, summed = parts.treeAggregate((0, np.zeros(SIZE)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]))
            if not gaps:
                break
            model = BoundaryModel(summed / gaps)
    finally:
        texts.unpersist()
    return model


def scores(docs: DataFrame, model: BoundaryModel, text_col: str = "text") -> tuple[float, float, float]:
    """Precision, recall and F1 of the ends that a model finds in texts whose signs it isn't shown."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hit = found = there = 0
        for f in frames:
            for text in f["text"]:
                spans, marked = units_of(text or "")
                ends = model.ends([text[a:b] for a, b in spans]) if spans else []
                hit += sum(a and b for a, b in zip(ends, marked))
                found += sum(ends)
                there += sum(marked)
        yield pd.DataFrame({"hit": [hit], "found": [found], "there": [there]})

    n = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "hit long, found long, there long").agg(F.sum("hit"), F.sum("found"), F.sum("there")).first()
    hit, found, there = (x or 0 for x in n)
    precision, recall = hit / max(found, 1), hit / max(there, 1)
    return precision, recall, 2 * precision * recall / max(precision + recall, 1e-12)
