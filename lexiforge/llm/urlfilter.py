"""URL filters: host and path rules, then a weighted vocabulary found by an Aho-Corasick automaton.

A strict term alone rejects a URL; soft terms reject it when several distinct
ones stand in it.  A hit counts only where neither a letter nor a digit is
next to it, so no term is found inside a longer word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, columns_of, pieces

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Terms of which one is enough.
STRICT = ("camgirls", "cialis", "escorts", "hentai", "keygen", "milf", "nsfw", "phishing", "porn", "porno", "sexcam", "viagra", "warez", "xxx")
#: Terms that also stand in harmless addresses; several distinct ones are needed.
SOFT = (
    "ads", "adult", "bet", "bets", "betting", "bonus", "casino", "cheap", "crack", "dating", "discount", "escort", "farm", "free", "gambling", "girls",
    "jackpot", "loan", "loans", "lottery", "nude", "payday", "pills", "poker", "popup", "prize", "replica", "serial", "sex", "sexy", "slots",
    "spam", "torrent", "track", "tracker", "win", "winner", "x", "xx",
)


class Rule(NamedTuple):
    """``verdict`` for addresses on ``host`` or a subdomain of it whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL, both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


class RuleTable:
    """Finds the longest rule that fits an address: one look-up for each label of the host."""

    def __init__(self, rules: Iterable[Rule]):
        self.by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule.host, []).append(rule)
        for fitting in self.by_host.values():
            fitting.sort(key=lambda r: -len(r.path))

    def find(self, host: str, path: str) -> Rule | None:
        best, at = None, 0
        while True:  # the host, then each domain above it
            rule = next((r for r in self.by_host.get(host[at:], ()) if path.startswith(r.path)), None)
            if rule and (best is None or len(rule.text) > len(best.text)):
                best = rule
            at = host.find(".", at) + 1
            if not at:
                return best


class Vocabulary:
    """Automaton over strict and soft terms; ``hits`` gives the distinct ones found with clear boundaries."""

    def __init__(self, strict: Iterable[str], soft: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):
            for term in terms:
                self.automaton.add_word(term, (kind, term))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        found: dict[str, set[str]] = {"strict": set(), "soft": set()}
        if len(self.automaton):
            for last, (kind, term) in self.automaton.iter(url):
                first = last - len(term)  # place before the hit
                if not (first >= 0 and url[first].isalnum()) and not (last + 1 < len(url) and url[last + 1].isalnum()):
                    found[kind].add(term)
        return found["strict"], found["soft"]


@functools.lru_cache(maxsize=4)
def _matchers(rules: tuple[Rule, ...], strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[RuleTable, Vocabulary]:
    return RuleTable(rules), Vocabulary(strict, soft)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[Rule] = RULES, strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, soft_limit: int = 2) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_terms, soft_terms for each input row.

    ``verdict`` is that of the longest fitting rule (by host and path together,
    then by host); without one it is ``block`` if the URL, A-Z lower-cased, holds
    a strict term or ``soft_limit`` distinct soft terms, else ``allow``.  A term
    given as both is strict.  The terms found are listed in order either way.

    Null URLs and URLs without ``://`` have an empty host and path; their whole
    text is searched.  Each row is judged alone, in its task: nothing is
    shuffled, repeated rows and null ids keep their rows.  Rules and terms
    travel with the task, so their number is the caller's to bound (10^5 or so).
    """
    rules, strict, soft = tuple(rules), tuple(t.lower() for t in strict), tuple(t.lower() for t in soft)
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict_terms", pa.list_(pa.string())), ("soft_terms", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = _matchers(rules, strict, soft)
        for batch in pieces(batches):
            ids, urls, hosts, paths = columns_of(batch, "page_id", "url", "host", "path")
            out = []
            for url, host, path in zip(urls, hosts, paths, strict=True):
                rule = table.find(host, path)
                hard, mild = words.hits(url or "")
                verdict = rule.verdict if rule else "block" if hard or len(mild) >= soft_limit else "allow"
                out.append((rule.text if rule else None, verdict, sorted(hard), sorted(mild)))
            if out:
                yield batch_of(schema, [ids, hosts, paths, *zip(*out, strict=True)])

    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.translate(url, UPPER, LOWER).alias("url"), host.alias("host"), path.alias("path"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>")
