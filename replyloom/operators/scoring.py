"""Applying a caller's model to rows, and the reply and judge steps built on it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from replyloom import constants as K
from replyloom.functions.answers import parse_judge_json, strip
from replyloom.functions.prompts import judge_prompt, reply_prompt
from replyloom.schemas import ANSWER
from replyloom.session import ship_package

# A loader builds the model; the model maps the input columns of some rows to output columns.
Model = Callable[[pd.DataFrame], pd.DataFrame]
Loader = Callable[[], Model]

_LOADED: dict[str, Model] = {}
# Models that a Python worker keeps; the one loaded first goes when another is needed.
_KEEP_LOADED = 4


def _token(load: Loader) -> str:
    """Names a loader by its content, so later plans and micro-batches find its model loaded."""
    return hashlib.sha256(cloudpickle.dumps(load)).hexdigest()


def _loaded(token: str, load: Loader) -> Model:
    if token not in _LOADED:
        while len(_LOADED) >= _KEEP_LOADED:
            del _LOADED[next(iter(_LOADED))]
        _LOADED[token] = load()
    return _LOADED[token]


def score_batches(df: DataFrame, load: Loader, inputs: Sequence[str], out: T.StructType,
                  when: Column | None = None) -> DataFrame:
    """Add a model's ``out`` columns to the rows that meet ``when``; other rows get nulls.

    The model is loaded once per Python worker, when the first row asks for it. Rows that need no answer pass through the same
    operator untouched, so a cheap rule saves the model call without reading the input twice.
    """
    ship_package(df.sparkSession)
    asked = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    token = _token(load)
    inputs, names = list(inputs), df.columns
    arrow_types = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches):
        for batch in batches:
            ask = np.flatnonzero(batch.column("__ask").to_numpy(zero_copy_only=False))
            columns = [batch.column(c) for c in names]
            if len(ask):
                rows = pa.Table.from_batches([batch]).select(inputs).take(pa.array(ask))
                result = _loaded(token, load)(rows.to_pandas())
                where = np.zeros(batch.num_rows, dtype=np.int64)
                where[ask] = np.arange(len(ask))
                skip = np.ones(batch.num_rows, dtype=bool)
                skip[ask] = False
                index = pa.array(where, mask=skip)
                columns += [
                    pa.Array.from_pandas(result[f.name], type=t).take(index)
                    for f, t in zip(out.fields, arrow_types)
                ]
            else:
                columns += [pa.nulls(batch.num_rows, t) for t in arrow_types]
            yield pa.RecordBatch.from_arrays(columns, names + out.names)

    schema = T.StructType(df.schema.fields + out.fields)
    return df.withColumn("__ask", asked).mapInArrow(run, schema)


def text_model(answer: Callable[[str], str], prompt: str = "prompt",
               name: str = "answer") -> Loader:
    """Wrap a plain ``prompt -> answer`` function as a loader."""
    def load() -> Model:
        return lambda rows: pd.DataFrame({name: [answer(p) for p in rows[prompt]]})
    return load


def drafted_only(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Rows that hold a reply."""
    return df.where(F.coalesce(F.col(reply), F.lit("")) != "")


def draft_reply(retrieved: DataFrame, load: Loader | None = None, message: str = "message",
                method: str = K.METHOD_TWO_STAGE, score=score_batches) -> DataFrame:
    """Add reply, grounded_on, top_similarity and ranking_method to one row per message.

    ``retrieved`` comes from :func:`replyloom.operators.retrieve.grounding`. Without a model the
    first case's own reply is used; with one, the model sees the filled prompt. The similarity is
    that of the first case after re-ranking, not the largest one.
    """
    cases = F.coalesce(F.col("cases"), F.array().cast(_case_type(retrieved)))
    out = (
        retrieved
        .withColumn("grounded_on", F.transform(cases, lambda c: c["pair_id"]))
        .withColumn("top_similarity", F.coalesce(F.get(cases, F.lit(0))["similarity"], F.lit(0.0)))
        .withColumn("ranking_method", F.lit(method))
    )
    if load is None:
        return out.withColumn("reply", F.get(cases, F.lit(0))["brand_reply"]).drop("cases")
    lines = F.array_join(F.transform(cases, lambda c: c["line"]), "\n")
    out = out.withColumn("prompt", reply_prompt(message, lines)).drop("cases")
    out = score(out, load, ["prompt"], ANSWER)
    return out.withColumn("reply", strip("answer")).drop("prompt", "answer")


def _case_type(df: DataFrame) -> T.DataType:
    return df.schema["cases"].dataType


def judge_replies(df: DataFrame, load: Loader, message: str = "customer_text",
                  reply: str = "reply", score=score_batches) -> DataFrame:
    """Ask a judging model about every drafted reply and add its scores as ``judge``."""
    asked = drafted_only(df, reply).withColumn("prompt", judge_prompt(message, reply))
    scored = score(asked, load, ["prompt"], ANSWER)
    return scored.withColumn("judge", parse_judge_json("answer")).drop("prompt", "answer")
