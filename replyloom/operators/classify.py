"""Intent of a message: emergency rule, model answer, second look, keyword cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from replyloom import constants as K
from replyloom.functions.answers import parse_intent_json
from replyloom.functions.prompts import classify_prompt, second_look_prompt
from replyloom.functions.rules import keyword_intent, resolve_intent, safety_match
from replyloom.operators.scoring import Loader, score_batches
from replyloom.schemas import ANSWER

_FIELDS = ("intent", "confidence", "rationale")
_TYPES = {"intent": "string", "confidence": "double", "rationale": "string"}


def reconsider_other(first: Column, second: Column, taxonomy=K.TAXONOMY) -> Column:
    """Take the second answer where the first said "other" and the second is in the taxonomy.

    Both arguments are parsed answers. Adds the flag ``reconsidered``.
    """
    taken = F.coalesce((first["intent"] == K.OTHER) & second["intent"].isin(*taxonomy), F.lit(False))
    return F.struct(
        *[F.when(taken, second[f]).otherwise(first[f]).alias(f) for f in _FIELDS],
        taken.alias("reconsidered"),
    )


def resolve_answers(df: DataFrame, text: str, first_answer: str, second_answer: str,
                    taxonomy=K.TAXONOMY) -> DataFrame:
    """Intent columns from raw answers: rule, then answer, then second look, then taxonomy."""
    second = F.when(F.col(second_answer).isNotNull(), parse_intent_json(second_answer))
    return (
        # Each answer is parsed in a step of its own, so its text is read once.
        df.withColumns({"__first": parse_intent_json(first_answer), "__second": second,
                        "__safe": safety_match(text)})
        .withColumn("__a", reconsider_other(F.col("__first"), F.col("__second"), taxonomy))
        .withColumn("intent", F.when(F.col("__safe"), K.SAFETY)
                    .otherwise(resolve_intent("__a.intent", taxonomy)))
        .withColumn("intent_confidence", F.when(F.col("__safe"), 1.0)
                    .otherwise(F.col("__a.confidence")))
        .withColumn("intent_rationale", F.when(F.col("__safe"), K.RATIONALE_SAFETY)
                    .otherwise(F.col("__a.rationale")))
        .withColumn("source", F.when(F.col("__safe"), K.SOURCE_SAFETY))
        .withColumn("reconsidered", ~F.col("__safe") & F.col("__a.reconsidered"))
        .drop("__a", "__first", "__second", "__safe")
    )


def ask_model(df: DataFrame, load: Loader, text: str, when: Column, *, second_look: bool = True,
              taxonomy=K.TAXONOMY, score=score_batches) -> DataFrame:
    """Add the columns first_answer and second_answer; only rows meeting ``when`` are asked,
    and only those that then answer "other" are asked again. Both steps are narrow, unless
    ``score`` is an answer book's, which keeps the answers and asks equal prompts once."""
    df = df.withColumn("prompt", classify_prompt(text, taxonomy=taxonomy))
    df = score(df, load, ["prompt"], ANSWER, when)
    df = df.withColumnRenamed("answer", "first_answer")
    if second_look:
        again = F.when(F.col("first_answer").isNotNull(),
                       parse_intent_json("first_answer")["intent"] == K.OTHER)
        df = df.withColumn("prompt", second_look_prompt("prompt", "first_answer", taxonomy))
        df = score(df, load, ["prompt"], ANSWER, again)
        df = df.withColumnRenamed("answer", "second_answer")
    else:
        df = df.withColumn("second_answer", F.lit(None).cast("string"))
    return df.drop("prompt")


def classify(df: DataFrame, load: Loader, text: str = "customer_text", *,
             second_look: bool = True, taxonomy=K.TAXONOMY, score=score_batches) -> DataFrame:
    """Intent of every row; rows caught by the emergency rule never reach the model."""
    asked = ask_model(df, load, text, ~safety_match(text), second_look=second_look,
                      taxonomy=taxonomy, score=score)
    return resolve_answers(asked, text, "first_answer", "second_answer",
                           taxonomy).drop("first_answer", "second_answer")


def cascade_answers(df: DataFrame, text: str, first_answer: str, second_answer: str,
                    lexicon=K.LEXICON, taxonomy=K.TAXONOMY) -> DataFrame:
    """Keyword intent first; rows it leaves at "other" take the classified answer.

    The fallback's source replaces the emergency rule's, whichever of the two decided.
    """
    names = ("intent", "intent_confidence", "intent_rationale", "reconsidered")
    keyword = keyword_intent(text, lexicon)
    out = resolve_answers(df.withColumn("__kw", keyword), text, first_answer, second_answer,
                          taxonomy)
    placed = F.col("__kw") != K.OTHER
    by_rule = (F.col("__kw"), F.lit(None).cast("double"), F.lit(K.RATIONALE_KEYWORD), F.lit(False))
    for name, value in zip(names, by_rule):
        out = out.withColumn(name, F.when(placed, value).otherwise(F.col(name)))
    return out.withColumn("source", F.when(placed, K.SOURCE_KEYWORD)
                          .otherwise(F.lit(K.SOURCE_FALLBACK))).drop("__kw")


def cascade(df: DataFrame, load: Loader, text: str = "customer_text", *, lexicon=K.LEXICON,
            taxonomy=K.TAXONOMY, score=score_batches) -> DataFrame:
    """Keyword rules first; the model sees only what they leave at "other"."""
    ask = (keyword_intent(text, lexicon) == K.OTHER) & ~safety_match(text)
    asked = ask_model(df, load, text, ask, taxonomy=taxonomy, score=score)
    return cascade_answers(asked, text, "first_answer", "second_answer", lexicon,
                           taxonomy).drop("first_answer", "second_answer")


def cascade_report(df: DataFrame) -> DataFrame:
    """Rows per source, and how many of them ended with an intent other than "other"."""
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("intent") != K.OTHER).alias("n_placed"),
    )
