"""Phrase tables: replacing in one pass, and finding all places of many phrases.

A table of tens of thousands of phrases travels with the task and is looked up in
Arrow batches; a plan with a nested expression for each phrase would not compile.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.written import bytes_within, cut

#: Bytes of a table that may travel to every task.
MOST_BYTES = 64 << 20


def held_table(rows: DataFrame, most: int = MOST_BYTES) -> list[tuple]:
    """The rows of a small table, for every task: its bytes are counted first, and too many are an error."""
    rows = cut(rows)
    if not bytes_within(rows, most):
        raise ValueError(f"a table of more than {most} bytes doesn't go to every task")
    return [tuple(r) for r in rows.toLocalIterator()]


def load_phrases(table: DataFrame, most: int = MOST_BYTES) -> dict[str, str]:
    """{phrase: replacement} of a table (phrase, to); of repeated phrases the least replacement, empty and null ones are left out."""
    rows = table.filter("phrase <> '' and to is not null").groupBy("phrase").agg(F.min("to").alias("to"))
    return dict(held_table(rows.select("phrase", "to"), most))


class Phrases:
    """A phrase table in one worker: the longest phrase at each place, from left to right, without overlaps."""

    def __init__(self, table: dict[str, str]):
        self.table = {k: v for k, v in table.items() if k}
        by_first: dict[str, set[int]] = {}
        for phrase in self.table:
            by_first.setdefault(phrase[0], set()).add(len(phrase))
        # single characters are the rule in such tables, so the longer lengths are tried only where one begins
        self.lengths = {c: sorted(n, reverse=True) for c, n in by_first.items()}

    def found(self, text: str) -> Iterator[tuple[int, str]]:
        """(place, phrase) of each match."""
        at, end = 0, len(text)
        lengths, table = self.lengths, self.table
        while at < end:
            for n in lengths.get(text[at], ()):
                phrase = text[at : at + n]
                if phrase in table:
                    yield at, phrase
                    at += n
                    break
            else:
                at += 1

    def replace(self, text: str) -> str:
        out, done = [], 0
        for at, phrase in self.found(text):
            out += text[done:at], self.table[phrase]
            done = at + len(phrase)
        return "".join(out) + text[done:]


def replace_phrases(text: Column, *passes: dict[str, str]) -> Column:
    """``text`` with the phrases of each table replaced, table after table; null stays null.

    Within a table the longest phrase at a place counts, from left to right, and
    what was put in is not looked at again; the next table sees all of it.
    """
    tables = [t for t in passes if t]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = [Phrases(t) for t in tables]

        def one(t: str | None) -> str | None:
            for phrases in made if t is not None else ():
                t = phrases.replace(t)
            return t

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text) if tables else text


class Finder:
    """All places of many words in a text, overlapping ones too."""

    def __init__(self, words: dict[str, list]):
        self.automaton = ahocorasick.Automaton()
        for word, values in words.items():
            self.automaton.add_word(word, (len(word), values))
        self.automaton.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, int, list]]:
        """(place, length, values) of each match."""
        for last, (n, values) in self.automaton.iter(text):
            yield last - n + 1, n, values
