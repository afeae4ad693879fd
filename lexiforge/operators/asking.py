"""Questions to a model from inside tasks: bounded, tried again, and never paid for twice.

A question is known by the hash of its text.  Answers lie in a spool that all
executors share from the moment they come, so a task that starts again, or a
later run, finds them there; once a run is done they move to a table.
"""

from __future__ import annotations

import asyncio
import json
import random
import uuid
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.sources.tablelog import TableLog

ANSWERS = "hash string, answer string"


class Spool:
    """Answers as small files by hash, in folders by the first letters of the hash."""

    def __init__(self, path: str):
        self.store, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def _file(self, hash_: str) -> str:
        return f"{self.path}/{hash_[:2]}/{hash_}.json"

    def get(self, hash_: str) -> str | None:
        try:
            with self.store.open_input_stream(self._file(hash_)) as f:
                return json.loads(f.read().decode())["answer"]
        except FileNotFoundError:
            return None

    def put(self, hash_: str, answer: str) -> None:
        """Visible as a whole or not at all."""
        to = self._file(hash_)
        self.store.create_dir(to.rsplit("/", 1)[0], recursive=True)
        draft = f"{to}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft) as f:
            f.write(json.dumps({"answer": answer}).encode())
        self.store.move(draft, to)


async def _one(call: Callable[[str], Awaitable[str]], question: str, tries: int, wait: float, limit: float) -> str | None:
    """The answer, tried again after growing pauses; None after the last try."""
    for k in range(tries):
        try:
            return await asyncio.wait_for(call(question), limit)
        except Exception:
            if k + 1 < tries:
                await asyncio.sleep(wait * 2**k * (0.5 + random.random()))
    return None


async def _all(call: Callable[[str], Awaitable[str]], questions: list[tuple[str, str]], spool: Spool, at_once: int, tries: int, wait: float, limit: float) -> list[str | None]:
    gate = asyncio.Semaphore(at_once)

    async def answer(hash_: str, question: str) -> str | None:
        async with gate:
            got = await _one(call, question, tries, wait, limit)
            if got is not None:
                spool.put(hash_, got)
            return got

    return await asyncio.gather(*(answer(h, q) for h, q in questions))


def ask(rows: DataFrame, question_col: str, call: Callable[[str], Awaitable[str]], path: str, at_once: int = 8, tasks: int = 16, tries: int = 4, wait: float = 0.5, limit: float = 120.0) -> DataFrame:
    """``rows`` with ``answer``: what ``call``, a coroutine, makes of the question; null where it failed ``tries`` times.

    Each distinct question is asked once, here and in later runs over the same
    ``path``; ``tasks`` tasks ask ``at_once`` questions each at a time, so the model
    sees ``tasks`` * ``at_once`` at most.  Failed questions are asked again in the
    next run.  Null questions have no answer.
    """
    log = TableLog(rows.sparkSession, f"{path}/answers", ANSWERS)
    spool_path = f"{path}/spool"
    asked = rows.withColumn("__hash", F.sha2(question_col, 256))
    open_ = asked.filter("__hash is not null").groupBy("__hash").agg(F.first(question_col).alias("question"))
    open_ = open_.join(log.read().select(F.col("hash").alias("__hash")), "__hash", "left_anti").select(F.col("__hash").alias("hash"), "question")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spool = Spool(spool_path)
        for f in frames:
            known = [spool.get(h) for h in f["hash"]]
            todo = [(h, q) for h, q, a in zip(f["hash"], f["question"], known, strict=True) if a is None]
            new = dict(zip((h for h, _ in todo), asyncio.run(_all(call, todo, spool, at_once, tries, wait, limit)), strict=True))
            yield pd.DataFrame({"hash": f["hash"], "answer": [a if a is not None else new[h] for h, a in zip(f["hash"], known, strict=True)]})

    version = log.append(open_.repartition(tasks, "hash").mapInPandas(run, ANSWERS).filter("answer is not null"))
    answers = log.read(version).groupBy("hash").agg(F.min("answer").alias("answer"))
    return asked.join(answers.withColumnRenamed("hash", "__hash"), "__hash", "left").drop("__hash")


def with_blanks(answers: DataFrame, fields: dict[str, str], answer_col: str = "answer") -> DataFrame:
    """``answers`` with the text fields of the JSON object in each answer, cut to so many characters as given; blank where there is no answer, no object or no such field."""
    found = F.regexp_extract(F.coalesce(F.col(answer_col), F.lit("")), r"(?s)(\{.*\})", 1)
    return answers.withColumns({name: F.substring(F.coalesce(F.get_json_object(found, f"$.{name}"), F.lit("")), 1, int(most)) for name, most in fields.items()})


def infer_metadata(docs: DataFrame, call: Callable[[str], Awaitable[str]], path: str, file_col: str = "file", text_col: str = "text", head: int = 1000, **options) -> DataFrame:
    """``docs`` with meeting_date, produced_date and origin as the model tells them from file name and beginning; blank where it can't or doesn't answer."""
    head_of = F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, head)
    question = F.concat(
        F.lit("From the file name and the beginning of a transcript, tell these fields; leave blank what can't be told.\nFile: "),
        F.coalesce(F.nullif(F.col(file_col), F.lit("")), F.lit("(none)")),
        F.lit("\nBeginning:\n"),
        head_of,
        F.lit('\n\nOnly JSON: {"meeting_date": "YYYY-MM-DD", "produced_date": "YYYY-MM-DD", "origin": "in short"}'),
    )
    told = ask(docs.withColumn("__question", question), "__question", call, path, **options)
    return with_blanks(told, {"meeting_date": 40, "produced_date": 40, "origin": 1000}).drop("__question", "answer")


def sheet_hints(terms: DataFrame, call: Callable[[str], Awaitable[str]], path: str, file_col: str = "file", order_col: str = "row", most: int = 40, **options) -> DataFrame:
    """file, hint: one line on what each sheet is about, told from its name and first ``most`` terms; blank where the model doesn't answer."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(file_col).orderBy(order_col, "term"))
    first = terms.filter("term <> ''").withColumn("__n", place).filter(F.col("__n") <= most)
    named = first.groupBy(F.col(file_col).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "term"))), lambda x: x["term"]), "、").alias("sample"))
    question = F.concat(F.lit("A table named “"), "file", F.lit("” has terms such as: "), "sample", F.lit(".\nSay in one sentence what field and what kind of data this is. Only that sentence."))
    told = ask(named.withColumn("question", question), "question", call, path, **options)
    return told.select("file", F.substring(F.replace(F.trim(F.coalesce("answer", F.lit(""))), F.lit("\n"), F.lit(" ")), 1, 150).alias("hint"))
