"""Readings of ideographs and kana from tables, and the sounds that lie near one another.

A run of ideographs is read along the shortest path through the words of a
reading table, so a character takes the sound it has in its word.  Tables
travel with the task; nothing of them enters the plan.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import phonetic as P
from lexiforge.functions.phrases import MOST_BYTES, held_table

HAN_RUN = re.compile("[一-鿿㐀-䶿]+")
KANA = re.compile("[぀-ヿ]")

# Columns of the kana table by consonant, in the order of the vowels a, i, u, e, o.
VOWELS = ("a", "i", "ɯ", "e", "o")
COLUMNS = {
    "あいうえお": "", "かきくけこ": "k", "がぎぐげご": "ɡ", "さしすせそ": "s", "ざじずぜぞ": "z", "たちつてと": "t", "だぢづでど": "d",
    "なにぬねの": "n", "はひふへほ": "h", "ばびぶべぼ": "b", "ぱぴぷぺぽ": "p", "まみむめも": "m", "らりるれろ": "ɾ",
}
CHANGED = {"し": "ɕ", "じ": "dʑ", "ち": "tɕ", "つ": "ts", "ぢ": "dʑ", "づ": "z", "ひ": "ç", "ふ": "ɸ"}
OTHER = {"や": ("j", "a"), "ゆ": ("j", "ɯ"), "よ": ("j", "o"), "わ": ("w", "a"), "ゐ": ("i",), "ゑ": ("e",), "を": ("o",), "ん": ("ɴ",), "ゔ": ("v", "ɯ"), "っ": ("ʔ",), "ー": ("ː",)}
GLIDES = {"ゃ": ("j", "a"), "ゅ": ("j", "ɯ"), "ょ": ("j", "o"), "ゎ": ("w", "a"), "ぁ": ("a",), "ぃ": ("i",), "ぅ": ("ɯ",), "ぇ": ("e",), "ぉ": ("o",)}

MORAE = {k: (CHANGED.get(k, c), v) if c else (v,) for ks, c in COLUMNS.items() for k, v in zip(ks, VOWELS, strict=True)} | OTHER


def morae(kana: str) -> list[list[str]]:
    """Sounds of each mora: a small sign replaces the vowel before it, katakana sound like hiragana, other signs stand for themselves."""
    out: list[list[str]] = []
    for c in kana:
        c = chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c
        if c in GLIDES and out and len(out[-1]) > 1 and out[-1][-1] in VOWELS:
            kept, glide = out[-1][:-1], GLIDES[c]
            # what is palatal already takes no further glide
            out[-1] = [*kept, *(glide[1:] if len(glide) == 2 and kept[-1] in ("ɕ", "tɕ", "dʑ") else glide)]
        else:
            out.append(list(MORAE.get(c) or GLIDES.get(c) or c))
    return out


class Lattice:
    """Words with their readings; a text is cut into as few of them as possible, with as few characters unread."""

    def __init__(self, words: dict[str, str]):
        self.words = {w: r for w, r in words.items() if w}
        by_first: dict[str, set[int]] = {}
        for w in self.words:
            by_first.setdefault(w[0], set()).add(len(w))
        self.lengths = {c: sorted(n, reverse=True) for c, n in by_first.items()}

    def path(self, text: str) -> list[tuple[str, str | None]]:
        """(piece, reading) in order; of equally short paths the one with the longer words first.  Characters of no word have no reading."""
        n = len(text)
        cost: list[tuple[int, int]] = [(0, 0)] * (n + 1)  # characters unread, pieces
        step = [1] * n
        for i in range(n - 1, -1, -1):
            ways = [(cost[i + k][0], cost[i + k][1] + 1, -k) for k in self.lengths.get(text[i], ()) if i + k <= n and text[i : i + k] in self.words]
            unread, pieces, k = min(ways, default=(n + 1, 0, 0))
            if unread > cost[i + 1][0] + 1:
                unread, pieces, k = cost[i + 1][0] + 1, cost[i + 1][1] + 1, -1
            cost[i], step[i] = (unread, pieces), -k
        out, i = [], 0
        while i < n:
            piece = text[i : i + step[i]]
            out.append((piece, self.words.get(piece)))
            i += step[i]
        return out


def token_distance(a: list[str], b: list[str], costs: P.Costs = P.DEFAULT) -> float:
    """``phonetic.distance`` of two token lists in Python, for words with tones inside tasks."""
    if not a or not b:
        return 0.0 if not a and not b else 1.0
    weight = lambda t: costs.tone if t in P.TONES else 1.0
    above = [0.0]
    for y in b:
        above.append(above[-1] + weight(y))
    for x in a:
        row = [above[0] + weight(x)]
        for j, y in enumerate(b):
            swap = 0.0 if x == y else costs.tone if x in P.TONES and y in P.TONES else costs.confuse if (x, y) in CONFUSED else 1.0
            row.append(min(above[j] + swap, above[j + 1] + weight(x), row[j] + weight(y)))
        above = row
    sounds = max(sum(t not in P.TONES for t in a), sum(t not in P.TONES for t in b), 1)
    return min(1.0, above[-1] / sounds)


CONFUSED = {tuple(p.split(" ")) for p in P.confusion_pairs()}


class Sounds:
    """Tokens and distances of words in one task."""

    def __init__(self, words: dict[str, str], japanese: dict[str, str] | None, costs: P.Costs):
        self.chinese, self.japanese, self.costs = Lattice(words), Lattice(japanese) if japanese is not None else None, costs
        self.syllable = functools.lru_cache(None)(lambda s: tuple(P.syllable_tokens(s)))
        self.near = functools.lru_cache(100_000)(lambda a, b: token_distance(list(self.syllable(a)), list(self.syllable(b)), costs))

    def tokens(self, word: str) -> list[str]:
        if self.japanese and KANA.search(word):  # the whole word is Japanese, its ideographs too
            kana = "".join(reading or piece for piece, reading in self.japanese.path(word))
            return [t for mora in morae(kana) for t in mora]
        out, done = [], 0
        for run in HAN_RUN.finditer(word):
            out += self._other(word[done : run.start()])
            for _, reading in self.chinese.path(run.group()):
                for syllable in (reading or "").split():
                    out += self.syllable(syllable)
            done = run.end()
        return out + self._other(word[done:])

    def _other(self, run: str) -> list[str]:
        """Signs without a table stand for themselves, kana for their morae."""
        return [t for mora in morae(run) for t in mora] if KANA.search(run) else list(run)

    def sound(self, han: str) -> str:
        """The syllable that a character has alone, or ``=`` and the character if it has no reading."""
        return (self.chinese.words.get(han) or "").split(" ")[0] or f"={han}"

    def word_distance(self, a: str, b: str) -> float:
        if a == b:
            return 0.0
        if HAN_RUN.fullmatch(a) and HAN_RUN.fullmatch(b):
            if len(a) != len(b):
                return 1.0
            pairs = [(self.sound(x), self.sound(y)) for x, y in zip(a, b, strict=True) if x != y]
            return max((1.0 if "=" in x + y else self.near(x, y) for x, y in pairs), default=0.0)
        x, y = self.tokens(a), self.tokens(b)
        return token_distance(x, y, self.costs) if x and y else 1.0


class Reader:
    """Readings for columns: ``words`` has syllables of ideographs and words, ``japanese`` kana; both are small tables.

    Readings are syllables with tone digits, one blank apart.  Without a Japanese
    table kana are read as they stand and ideographs as Chinese ones.
    """

    def __init__(self, words: dict[str, str] = P.READINGS, japanese: dict[str, str] | None = None, costs: P.Costs = P.DEFAULT):
        self.words, self.japanese, self.costs = words, japanese, costs

    @staticmethod
    def of(words: DataFrame, japanese: DataFrame | None = None, costs: P.Costs = P.DEFAULT, most: int = MOST_BYTES) -> Reader:
        """From tables (word, reading), whose bytes are counted; of several readings of a word the least one."""

        def load(table: DataFrame) -> dict[str, str]:
            once = table.filter("word <> '' and reading <> ''").groupBy("word").agg(F.min("reading").alias("reading"))
            return dict(held_table(once, most))

        return Reader(load(words), None if japanese is None else load(japanese), costs)

    def made(self) -> Sounds:
        return Sounds(self.words, self.japanese, self.costs)

    def _column(self, name: str, kind: str, *columns: Column) -> Column:
        make, several = functools.partial(Sounds, self.words, self.japanese, self.costs), len(columns) > 1

        def apply(frames: Iterator) -> Iterator[pd.Series]:
            of = getattr(make(), name)
            for frame in frames:
                rows = zip(*frame, strict=True) if several else ((x,) for x in frame)
                yield pd.Series([None if None in row else of(*row) for row in rows], dtype=object)

        # the hints tell Spark one column from several
        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from apply(batches)

        def two(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            yield from apply(batches)

        return F.pandas_udf(two if several else one, kind)(*columns)

    def tokens(self, word: Column) -> Column:
        """Tokens of a word, run by run."""
        return self._column("tokens", "array<string>", word)

    def ipa(self, word: Column) -> Column:
        return F.array_join(self.tokens(word), " ")

    def word_distance(self, a: Column, b: Column) -> Column:
        """Distance of two words: for ideographs the largest over the characters, else over the tokens of the words."""
        return self._column("word_distance", "double", a, b)

    def sounds(self, word: Column) -> Column:
        """The sound of each character of a word of ideographs."""
        han = functools.partial(Sounds, self.words, self.japanese, self.costs)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            sound = functools.lru_cache(None)(han().sound)
            for words in batches:
                yield pd.Series([None if w is None else [sound(c) for c in w] for w in words], dtype=object)

        return F.pandas_udf(run, "array<string>")(word)

    def neighbours(self, spark: SparkSession, limit: float) -> DataFrame:
        """(sound, near) for all syllables of the table: those within the limit of one another, themselves included.

        Their number is that of the syllables of a language; each task compares its share with all of them.
        """
        syllables = sorted({s for r in self.words.values() for s in r.split()})
        costs = self.costs
        segments = {s: sum(t not in P.TONES for t in P.syllable_tokens(s)) for s in syllables}

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tokens = {s: P.syllable_tokens(s) for s in syllables}
            for f in frames:
                pairs = [(a, b) for a in f["sound"] for b in syllables if abs(segments[a] - segments[b]) <= limit * max(segments[a], segments[b]) and token_distance(tokens[a], tokens[b], costs) <= limit]
                yield pd.DataFrame(pairs, columns=["sound", "near"])

        rows = spark.createDataFrame([(s,) for s in syllables], "sound string").repartition(min(64, max(1, len(syllables) // 16)))
        return rows.mapInPandas(run, "sound string, near string")
