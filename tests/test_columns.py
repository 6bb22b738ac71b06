"""Edge rows of the column helpers."""

import json

import pytest
from pyspark.sql import functions as F

from replyloom import constants as K
from replyloom.functions import answers as A, prompts as P, rules as R, text as X


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_handles_urls_and_spaces(spark):
    rows = ["@ann hi", "mail a@b.c", "see https://x.y/@me?q=1 ok", "HTTP://KEEP.me x", "@élodie_1 ça va",
            "a \tb\n c ", "", None, " x　"]
    assert values(spark, X.clean_text("c"), rows) == [
        "hi", "mail a.c", "see ok", "HTTP://KEEP.me x", "ça va", "a b c", "", None, "x"]


def test_handle_inside_link_is_removed_first(spark):
    assert values(spark, X.clean_text("c"), ["https://t.co/@bob/x end"]) == ["end"]


def test_signature_only_for_replies(spark):
    rows = ["Done ^A", "Done ^ABC ", "Done ^ABCD", "Done ^AB https://t.co/1", "mid ^AB text", "^AB"]
    assert values(spark, X.clean_text("c", True), rows) == [
        "Done", "Done", "Done ^ABCD", "Done", "mid ^AB text", ""]
    assert values(spark, X.clean_text("c"), rows[:1]) == ["Done ^A"]


def test_script_ratio(spark):
    rows = ["abcdefg" + "説" * 3, "abcdef" + "説" * 4, "", "αβγ", "çàéß", "ok 👍👍👍", None]
    assert values(spark, X.is_latin_script("c"), rows) == [True, False, True, False, True, False, None]
    assert values(spark, X.non_latin_ratio("c"), rows[:1]) == [0.3]


def test_long_enough_counts_code_points(spark):
    assert values(spark, X.long_enough("c"), ["ab", "abc", "👍👍", "👍👍👍", "", None]) == [
        False, True, False, True, False, False]


def test_two_decimals_round_like_the_binary_value(spark):
    numbers = [0.745, 0.125, 0.375, 2.675, 1.005, 0.0, 12345.678, 0.545]
    assert values(spark, X.fmt2("c"), numbers, "double") == [f"{n:.2f}" for n in numbers]


def test_keyword_priority_and_substrings(spark):
    rows = ["refund, the app is BROKEN", "lovely disorder", "please download", "I can’t sign in",
            "CAN'T SIGN IN", "nothing here", "", None]
    assert values(spark, R.keyword_intent("c"), rows) == [
        "billing_refund", "order_delivery", "service_outage", "other", "account_access", "other", "other",
        "other"]


def test_keyword_lexicon_is_a_parameter(spark):
    lexicon = (("greeting", ("hello",)), ("farewell", ("bye",)))
    assert values(spark, R.keyword_intent("c", lexicon, "none"), ["bye hello", "bye", "x"]) == [
        "greeting", "farewell", "none"]


def test_safety_rule(spark):
    rows = ["Call 911", "POLICE!", "unsafe", None]
    got = values(spark, R.safety_rule("c"), rows)
    assert [g and g["intent"] for g in got] == ["safety_incident", "safety_incident", None, None]
    assert got[0]["confidence"] == 1.0 and got[0]["source"] == "safety_rule"


def test_resolve_intent(spark):
    assert values(spark, R.resolve_intent("c"), ["other", "weather", None, "service_outage"]) == [
        "other", "other", "other", "service_outage"]


@pytest.mark.parametrize("intent,conf,sim,n,escalate", [
    ("general_inquiry", 0.75, 0.55, 0, False),
    ("general_inquiry", 0.745, 0.55, 1, True),
    ("general_inquiry", None, 0.9, 1, True),
    ("general_inquiry", 0.9, None, 1, True),
    ("billing_refund", 0.9, 0.9, 1, True),
    ("account_access", None, None, 3, True),
])
def test_escalation_table(spark, intent, conf, sim, n, escalate):
    df = spark.createDataFrame([(intent, conf, sim)], "intent string, conf double, sim double")
    row = df.select(R.decide_escalation("intent", "conf", "sim").alias("v")).first()["v"]
    assert row["escalate"] is escalate
    assert len(row["escalation_reasons"]) == max(n, 1)
    if n == 0:
        assert row["escalation_reasons"] == [K.REASON_AUTO]
    if conf is None and n == 3:
        assert row["escalation_reasons"][1] == "low classifier confidence (0.00 < 0.75)"


def test_intent_answers(spark):
    good = {"intent": "other", "confidence": 0.5, "rationale": "r"}
    rows = [json.dumps(good), f"```json\n{json.dumps(good)}\n```", f"```\n{json.dumps(good)}```",
            "```JSON " + json.dumps(good) + "```", "prose " * 30, "[1, 2]", '"text"', '{"confidence": 1}',
            '{"intent": "x", "confidence": "0.9"}', "", None, "{broken"]
    got = values(spark, A.parse_intent_json("c"), rows)
    assert [tuple(g) for g in got[:4]] == [("other", 0.5, "r")] * 4
    assert got[4]["rationale"] == "unparseable: " + ("prose " * 30)[:80]
    assert [g["intent"] for g in got[5:]] == ["other", "other", None, "x", "other", "other", "other"]
    assert [g["confidence"] for g in got[5:]] == [0.0, 0.0, 1.0, None, 0.0, 0.0, 0.0]


def test_judge_answers(spark):
    rows = ['{"relevance": 1, "correctness": 2, "tone": 3, "completeness": 4, "overall": 5, "rationale": "r"}',
            "no", '{"overall": 2}']
    got = values(spark, A.parse_judge_json("c"), rows)
    assert tuple(got[0]) == (1, 2, 3, 4, 5, "r")
    assert got[1]["overall"] is None and got[1]["rationale"] == "unparseable: no"
    assert got[2]["overall"] == 2 and got[2]["tone"] is None


def test_prompt_values_are_not_templates(spark):
    out = values(spark, P.judge_prompt("c", F.lit("{message}")), ["{reply} and {x}"])[0]
    assert 'Customer: {reply} and {x}' in out and "Reply: {message}" in out


def test_examples_block_follows_rank(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "rank int, line string")
    block = df.agg(P.examples_block(F.collect_list(F.struct("rank", "line"))).alias("b")).first()["b"]
    assert block == "a\nb\nc"
