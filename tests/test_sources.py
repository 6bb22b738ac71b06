"""Readers, writers and the append store."""

import json

import pytest

from replyloom import schemas
from replyloom.operators.features import encoder
from replyloom.plans.brand_pairs import csv_to_pairs
from replyloom.plans.corpus import build_corpus
from replyloom.sources import io

CSV = '''tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id
1,115712,True,Tue Oct 31 22:10:47 +0000 2017,"@brand it says ""no"",
twice",2,
2,brand,False,Tue Oct 31 22:11:45 +0000 2017,@115712 we are sorry ^AB,,1.0
3,brand,False,Tue Oct 31 22:12:45 +0000 2017,@115712 please write to us,,1
'''


@pytest.fixture
def csv_path(tmp_path):
    path = tmp_path / "messages.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_types_quotes_and_line_breaks(spark, csv_path):
    df = io.read_messages_csv(spark, csv_path)
    assert df.schema == schemas.MESSAGES
    rows = df.orderBy("tweet_id").collect()
    assert rows[0]["text"] == '@brand it says "no",\ntwice' and rows[0]["inbound"] is True
    assert [r["in_response_to_tweet_id"] for r in rows] == [None, 1, 1]
    assert rows[1]["inbound"] is False


def test_csv_is_bound_by_name(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("text,extra,tweet_id,author_id,inbound,created_at,response_tweet_id,in_response_to_tweet_id\n"
                    "hi,x,5,a,True,t,,\n")
    row = io.read_messages_csv(spark, str(path)).first()
    assert (row["tweet_id"], row["text"], row["author_id"]) == (5, "hi", "a")
    path.write_text("tweet_id,text\n1,a\n")
    with pytest.raises(ValueError):
        io.read_messages_csv(spark, str(path))


def test_csv_to_pairs(spark, csv_path, tmp_path):
    out = str(tmp_path / "pairs")
    csv_to_pairs(spark, csv_path, "brand", out)
    rows = io.read_jsonl(spark, out, schemas.PAIRS).orderBy("brand_tweet_id").collect()
    assert [(r["pair_id"], r["customer_text"], r["brand_reply"]) for r in rows] == [
        ("1_2", 'it says "no", twice', "we are sorry"), ("1_3", 'it says "no", twice', "please write to us")]
    with pytest.raises(ValueError):
        csv_to_pairs(spark, csv_path, "nobody", str(tmp_path / "none"))


def test_jsonl_writes_nulls_and_reads_absent_fields(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "pair_id string, gold_escalate boolean")
    io.write_jsonl(df, str(tmp_path / "j"))
    line = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert json.loads(line) == {"pair_id": "a", "gold_escalate": None}
    assert io.read_jsonl(spark, str(tmp_path / "j"), schemas.GOLDEN).first()["notes"] is None


def test_corpus_without_model_name_gets_the_default(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0])], "pair_id string, embedding array<float>")
    io.save_corpus(df, str(tmp_path / "new"), "my-encoder")
    df.write.parquet(str(tmp_path / "old"))
    assert io.load_corpus(spark, str(tmp_path / "new")).first()["model_name"] == "my-encoder"
    assert io.load_corpus(spark, str(tmp_path / "old"), "fallback").first()["model_name"] == "fallback"


def test_pairs_to_corpus(spark, csv_path, tmp_path):
    pairs, out = str(tmp_path / "pairs"), str(tmp_path / "corpus")
    csv_to_pairs(spark, csv_path, "brand", pairs)
    build_corpus(spark, pairs, out, encoder(lambda texts: [[3.0, 4.0] for _ in texts]), model_name="two")
    corpus = io.load_corpus(spark, out)
    assert corpus.schema.simpleString() == schemas.CORPUS.simpleString()
    assert [(r["model_name"], [round(x, 4) for x in r["embedding"]]) for r in corpus.collect()] == [
        ("two", [0.6, 0.8])] * 2


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_append_twice_is_once(spark, tmp_path, fmt):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "pair_id string, n int")
    for _ in range(2):
        io.append_new(df, path, fmt=fmt)
    rows = sorted((str(r["pair_id"]), r["n"]) for r in io.read_store(spark, path, df.schema, fmt).collect())
    assert rows == [("None", 3), ("None", 3), ("a", 1), ("b", 2)]


def test_broken_stored_line_is_run_again(spark, tmp_path):
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part.json").write_text('{"pair_id": "a", "n": 1}\n\n{"pair_id": "b", "n"')
    df = spark.createDataFrame([("a", 1), ("b", 2)], "pair_id string, n int")
    io.append_new(df, str(tmp_path / "store"))
    rows = io.read_store(spark, str(tmp_path / "store"), df.schema).collect()
    assert sorted(r["pair_id"] for r in rows) == ["a", "b"]
