"""Pairing, duplicates, hot keys, samples and ranks."""

import pytest
from pyspark.sql import functions as F

from conftest import executed_plan
from replyloom.operators.keys import (first_by_key, global_rank, grounding_leak, join_gold_pred, last_by_key,
                                      lookup_join, require_overlap, unprocessed)
from replyloom.operators.pairs import brand_biased_sample, build_pairs, drop_report
from replyloom.operators.sampling import (can_train, cluster_count, cluster_stratified_sample, holdout_split)

SCHEMA = ("seq int, tweet_id bigint, author_id string, inbound boolean, created_at string, text string, "
          "in_response_to_tweet_id bigint")
ROWS = [
    (1, 1, "c", True, "t1", "my login fails", None),
    (2, 2, "b", False, "t2", "@c try again ^AB", 1),        # kept
    (3, 3, "b", False, "t3", "no parent given", None),
    (4, 4, "b", False, "t4", "missing parent", 99),
    (5, 5, "b", False, "t5", "parent is the brand", 2),
    (6, 6, "b", False, "t6", "first copy is the brand", 20),
    (7, 20, "b", False, "t7", "brand copy", None),
    (8, 20, "c", True, "t8", "customer copy", None),
    (9, 7, "b", False, "t9", "first copy is the customer", 21),   # kept
    (10, 21, "c", True, "t10", "customer first", None),
    (11, 21, "b", False, "t11", "brand second", None),
    (12, 8, "b", False, "t12", "unknown direction", 22),
    (13, 22, "c", None, "t13", "null inbound", None),
    (14, 9, "b", False, "t14", "null text", 23),
    (15, 23, "c", True, "t15", None, None),
    (16, 10, "b", False, "t16", "foreign text", 24),
    (17, 24, "c", True, "t17", "説明説明説明", None),
    (18, 11, "b", False, "t18", "@c ok", 1),                # reply too short
    (19, 2, "b", False, "t19", "second row of reply 2", 1),     # kept unless deduplicated
    (20, 12, "b", None, "t20", "null inbound reply", 1),
    (21, 13, "other", False, "t21", "another brand", 1),
]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


def test_pairs_and_their_edges(messages):
    rows = build_pairs(messages, "b", ("seq",)).collect()
    assert sorted((r["pair_id"], r["brand_reply"], r["created_at"]) for r in rows) == [
        ("1_2", "second row of reply 2", "t1"), ("1_2", "try again", "t1"),
        ("21_7", "first copy is the customer", "t10")]


def test_options(messages):
    def ids(**options):
        return sorted(r["pair_id"] for r in build_pairs(messages, "b", ("seq",), **options).collect())
    assert ids(dedupe=True) == ["1_2", "21_7"]
    assert ids(latin_only=False) == ["1_2", "1_2", "21_7", "24_10"]
    assert ids(min_chars=2) == ["1_11", "1_2", "1_2", "21_7"]
    assert build_pairs(messages, "nobody", ("seq",)).isEmpty()


def test_drop_report(messages):
    report = {r["outcome"]: r["n_replies"]
              for r in drop_report(messages, "b", ("seq",)).collect()}
    # The brand's own copies of messages 20 and 21 have no parent id either.
    assert report == {"no_parent_id": 3, "parent_missing": 1, "parent_not_customer": 3, "too_short": 2,
                      "non_latin": 1, "kept": 3}


def test_filter_reaches_the_scan_and_ids_are_broadcast(spark, conf, tmp_path, messages):
    conf({"spark.sql.maxMetadataStringLength": "2000"})
    path = str(tmp_path / "m")
    messages.write.parquet(path)
    plan = executed_plan(build_pairs(spark.read.parquet(path), "b", ("seq",)))
    assert "EqualTo(author_id,b)" in plan and "Not(EqualTo(inbound,true))" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "LeftSemi" in plan


SKEW = {"spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_is_split(spark, conf, how):
    conf(SKEW)
    left = spark.range(0, 90000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"),
        F.md5(F.col("id").cast("string")).alias("v"))
    right = first_by_key(spark.range(0, 12000, 1, 4).select(
        (F.col("id") % 6000).alias("rk"), F.col("id").alias("o")), ["rk"], ["o"])
    joined = lookup_join(left, right, "k", "rk", how)
    assert joined.columns == ["k", "v", "rk", "o"]
    rows = joined.toArrow()
    assert rows.num_rows == 90000
    plan = executed_plan(joined)
    assert "skew=true" in plan


def test_rows_without_a_key_are_spread(spark, conf):
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1",
          "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
          "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    left = spark.range(0, 4000, 1, 4).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), F.col("id").alias("v"),
        F.create_map(F.lit("a"), "id").alias("m"))
    right = spark.range(100).select(F.col("id").alias("rk"), F.lit("x").alias("o"))
    joined = lookup_join(left, right, "k", "rk", "left")
    assert joined.columns == ["k", "v", "m", "rk", "o"]
    rows = joined.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["v"] for r in rows) == list(range(4000))
    assert {r["v"] for r in rows if r["o"]} == set(range(0, 100, 10))
    keyless = [r["task"] for r in rows if r["k"] is None]
    assert max(keyless.count(t) for t in set(keyless)) < len(keyless) / 2


def test_candidates_are_not_sorted_and_carry_each_column_once(spark, conf, messages):
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "2000"})
    half = messages.where("seq < 12").unionByName(messages.where("seq >= 12"))
    order = ("tweet_id", "created_at", "text")
    for frame in (build_pairs(half, "b", order), drop_report(half, "b", order)):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        # The filter by wanted ids hashes them; each half of the messages passes by unsorted.
        semi = [line for line in plan.splitlines() if "LeftSemi" in line]
        assert len(semi) == 2 and all("ShuffledHashJoin" in line for line in semi)
        assert "__o" not in plan
    rows = build_pairs(half, "b", order).collect()
    assert sorted((r["pair_id"], r["brand_reply"]) for r in rows) == [
        ("1_2", "second row of reply 2"), ("1_2", "try again"), ("21_7", "first copy is the customer")]


def test_first_row_by_carried_and_by_copied_columns(messages):
    def pairs(*order):
        return sorted(r["pair_id"] for r in build_pairs(messages, "b", order).collect())
    assert pairs("text", "seq") == pairs("inbound", "seq") == ["1_2", "1_2"]
    assert pairs(-F.col("seq")) == ["1_2", "1_2", "20_6"]


def test_repeated_ids_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    firsts = first_by_key(df, ["k"], ["id"])
    assert "WindowGroupLimit" in executed_plan(firsts)
    assert sorted(r["id"] for r in firsts.collect()) == [0, 1, 2]
    assert sorted(r["id"] for r in last_by_key(df, ["k"], ["id"]).collect()) == [97, 98, 99]


def test_gold_and_predictions(spark):
    gold = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "pair_id string, seq int, g string")
    pred = spark.createDataFrame([("a", 1, "p"), ("a", 5, "q"), ("c", 2, "r")], "pair_id string, seq int, p string")
    rows = join_gold_pred(gold, pred, ("seq",), ("seq",)).collect()
    assert [(r["pair_id"], r["g"], r["p"], r["seq"]) for r in rows] == [("a", "y", "q", 2)]
    with pytest.raises(ValueError):
        require_overlap(join_gold_pred(gold.where("pair_id = 'b'"), pred, ("seq",), ("seq",)))


def test_unprocessed_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "pair_id string")
    done = spark.createDataFrame([("a",), (None,), ("",)], "pair_id string")
    assert sorted(map(str, (r["pair_id"] for r in unprocessed(df, done).collect()))) == ["", "None", "b"]


def test_leak_flag(spark):
    df = spark.createDataFrame([("a", ["x", "a"]), ("a", ["x"]), ("a", None), (None, ["x"])],
                               "pair_id string, grounded_on array<string>")
    assert [r[0] for r in df.select(grounding_leak("grounded_on", "pair_id")).collect()] == [
        True, False, False, False]


def test_global_rank_equals_one_sorted_window(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 700).alias("a"), "id")
    rows = global_rank(df, ["a", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 5001))
    assert [(r["a"], r["id"]) for r in rows] == sorted((r["a"], r["id"]) for r in rows)


def test_holdout_is_ordered_and_guarded(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(188)], "i int, gold_intent string")
    split = holdout_split(df, ("i",))
    train = sorted(r["i"] for r in split.where("is_train").collect())
    assert train == list(range(131))
    assert can_train(split)
    assert not can_train(holdout_split(df.where("gold_intent = 'x'"), ("i",)))
    assert not can_train(holdout_split(df.where("i < 6"), ("i",)))
    assert not can_train(holdout_split(df.where("i < 0"), ("i",)))


def test_sample_is_off_for_zero_and_both_ways_agree(messages):
    assert brand_biased_sample(messages, "b", 0, ("seq",)) is messages
    assert brand_biased_sample(messages, "b", None, ("seq",)) is messages
    for n in (1, 3, 100):
        a = brand_biased_sample(messages, "b", n, ("seq",)).collect()
        b = brand_biased_sample(messages, "b", n, ("seq",)).collect()
        assert sorted(r["seq"] for r in a) == sorted(r["seq"] for r in b)
        assert len({r["tweet_id"] for r in a}) == len(a)
    whole = {r["tweet_id"] for r in brand_biased_sample(messages, "b", 100, ("seq",)).collect()}
    assert whole == {r[1] for r in ROWS}


def test_sample_keeping_parents(messages):
    kept = brand_biased_sample(messages, "b", 1, ("seq",), keep_parents=True)
    pairs = {r["pair_id"] for r in build_pairs(kept, "b", ("seq",)).collect()}
    assert "1_2" in pairs


def test_cluster_sample_sizes(spark):
    df = spark.createDataFrame(
        [(f"p{i:03}", 0 if i < 200 else i % 7, [float(i % 13), float(i % 5)]) for i in range(300)],
        "pair_id string, cluster int, embedding array<float>")
    assert (cluster_count(200), cluster_count(1), cluster_count(30)) == (20, 2, 5)
    assert cluster_stratified_sample(df, 1).count() == 1
    assert cluster_stratified_sample(df, 3).count() == 3
    rows = cluster_stratified_sample(df, 200).collect()
    # 8 of each of the 7 clusters, and the 30 farthest others.
    assert len(rows) == 7 * 8 + 30
    assert [r["pair_id"] for r in rows] == sorted(r["pair_id"] for r in rows)
