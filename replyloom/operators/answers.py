"""Answers of a model, kept in a ledger that is addressed by model name and prompt.

Equal prompts are asked once, however many rows have them and however often a job is run. What is
missing is asked in portions of bounded size, each committed when it is done, so an interrupted run
goes on with the portions that it has not committed. A failing call is tried again after waits that
double; a prompt that fails every time is recorded as answered by nothing, with the error, which the
parsers of answers read as unparseable.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from replyloom.operators.keys import lookup_join
from replyloom.operators.scoring import Loader, Model, _loaded, _token
from replyloom.schemas import ANSWER, struct
from replyloom.session import materialise, ship_package
from replyloom.sources.ledger import Ledger

#: Rows of the ledger: address, model, answer (null: every attempt failed), attempts and error.
ENTRIES = struct(address=T.StringType(), model=T.StringType(), answer=T.StringType(),
                 attempts=T.IntegerType(), error=T.StringType())
#: Prompts that are asked and committed together.
PORTION = 10_000
#: Prompts that one call of the model gets.
CALL_ROWS = 64


@dataclass(frozen=True)
class Retry:
    """How often a call is made, and the seconds waited before the second one; waits double."""

    attempts: int = 4
    wait: float = 1.0
    longest: float = 60.0

    def waits(self) -> Iterator[float]:
        """Seconds to wait before each attempt."""
        yield 0.0
        for i in range(self.attempts - 1):
            yield min(self.longest, self.wait * 2 ** i)


def ask_with_retry(model: Model, rows: pd.DataFrame, retry: Retry, name: str = "answer",
                   sleep: Callable[[float], None] = time.sleep) -> pd.DataFrame:
    """``answer, attempts, error`` of each row.

    The rows are asked together. If that fails they are asked one by one, so that a row that
    always fails costs the others nothing but the second call.
    """
    def tried(part: pd.DataFrame, waits: Sequence[float]) -> pd.DataFrame | Exception:
        failed: Exception = RuntimeError("not tried")
        for n, wait in enumerate(waits, 1):
            if wait:
                sleep(wait)
            try:
                answers = list(model(part)[name])
                if len(answers) != len(part):
                    raise ValueError(f"{len(answers)} answers to {len(part)} prompts")
                return pd.DataFrame({"answer": answers, "attempts": n, "error": None})
            except Exception as error:  # a model may raise anything; it is recorded
                failed = error
        return failed

    waits = list(retry.waits())
    together = tried(rows, waits[:1])
    if isinstance(together, pd.DataFrame):
        return together
    out = []
    for i in range(len(rows)):
        one = tried(rows.iloc[i:i + 1], waits[1:] or waits)
        if isinstance(one, pd.DataFrame):
            one["attempts"] += 1
        else:
            one = pd.DataFrame({"answer": [None], "attempts": [len(waits)],
                                "error": [f"{type(one).__name__}: {one}"[:500]]})
        out.append(one)
    return pd.concat(out, ignore_index=True)


def address(model: str, prompt: Column | str) -> Column:
    """Where the answer of a model to a prompt is kept."""
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}"), prompt), 256)


class AnswerBook:
    """The stored answers of any models below ``path``."""

    def __init__(self, spark: SparkSession, path: str, retry: Retry = Retry(),
                 portion: int = PORTION) -> None:
        self.ledger = Ledger(spark, path, ENTRIES, "address")
        self.retry, self.portion = retry, portion

    def complete(self, prompts: DataFrame, model: str, load: Loader) -> int:
        """Ask for the answers that ``prompts`` (one column, ``prompt``) still lack.

        Returns how many were asked. Portions are dealt by the address, so they are the same in
        every run, and each is one job and one commit.
        """
        spark = prompts.sparkSession
        ship_package(spark)
        asked = prompts.where(F.col("prompt").isNotNull()).select(
            address(model, "prompt").alias("address"), "prompt").dropDuplicates(["address"])
        todo = materialise(self.ledger.missing(asked))
        portions = math.ceil(todo.count() / self.portion)
        token, retry = _token(load), self.retry

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), CALL_ROWS):
                    part = batch.iloc[at:at + CALL_ROWS].reset_index(drop=True)
                    got = ask_with_retry(_loaded(token, load), part[["prompt"]], retry)
                    yield pd.DataFrame({"address": part["address"], "model": model,
                                        "answer": got["answer"], "attempts": got["attempts"],
                                        "error": got["error"]})

        n = 0
        of = F.pmod(F.xxhash64("address"), F.lit(max(1, portions)))
        for i in range(portions):
            n += self.ledger.append(todo.where(of == i).mapInPandas(run, ENTRIES))
        return n

    def answers(self) -> DataFrame:
        return self.ledger.rows()

    def score(self, df: DataFrame, model: str, load: Loader, when: Column | None = None,
              prompt: str = "prompt") -> DataFrame:
        """``df`` with ``answer`` for the rows that meet ``when``, as ``score_batches`` adds it.

        Only prompts without a stored answer reach the model.
        """
        asked = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
        rows = materialise(df.withColumn("__ask", asked & F.col(prompt).isNotNull()))
        self.complete(rows.where("__ask").select(F.col(prompt).alias("prompt")), model, load)
        known = self.answers().where(F.col("model") == model).select(
            F.col("address").alias("__at"), "answer")
        out = lookup_join(rows.withColumn("__address", F.when(
            F.col("__ask"), address(model, prompt))), known, "__address", "__at", "left")
        return out.drop("__ask", "__address", "__at")

    def scorer(self, model: str):
        """This book in place of ``score_batches``, for classify, cascade, drafts and the judge."""
        def score(df: DataFrame, load: Loader, inputs: Sequence[str], out: T.StructType,
                  when: Column | None = None) -> DataFrame:
            if list(inputs) != ["prompt"] or out != ANSWER:
                raise ValueError("stored answers are those of one prompt")
            return self.score(df, model, load, when)
        return score
