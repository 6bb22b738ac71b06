"""Append ledger, stored answers and keyed stream state: interrupted, repeated and parallel runs."""

import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from conftest import executed_plan
from replyloom.catalog import views as V
from replyloom.operators import answers as A
from replyloom.operators.classify import classify
from replyloom.operators.scoring import text_model
from replyloom.plans.triage import stored_answers, triage_ledger
from replyloom.schemas import PREDICTIONS, struct
from replyloom.sources.ledger import Ledger
from replyloom.streaming.triage_stream import once_per_key, stored_decisions, triage_stream

SF_DIR = "/root/testdata/sf0.001"
ROWS = struct(pair_id=T.StringType(), n=T.LongType())


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def content(ledger):
    return sorted((str(r.pair_id), r.n) for r in ledger.rows().collect())


def test_append_stores_a_key_once_and_keyless_rows_always(spark, tmp_path):
    store = Ledger(spark, str(tmp_path / "store"), ROWS, buckets=4)
    rows = frame(spark, [("a", 1), ("b", 2), (None, 3), ("", 4)])
    assert store.rows().isEmpty() and store.append(rows) == 4 and store.append(rows) == 2
    assert store.append(frame(spark, [("c", 5), ("c", 5)])) == 1
    assert content(store) == sorted([("a", 1), ("b", 2), ("None", 3), ("", 4), ("None", 3), ("", 4),
                                     ("c", 5)])
    again = Ledger(spark, str(tmp_path / "store"), ROWS, buckets=99)
    assert again.buckets == 4 and again.append(rows.where("n < 3")) == 0
    assert sorted(r.pair_id for r in again.missing(frame(spark, [("a", 1), ("z", 1)])).collect()) == ["z"]
    with pytest.raises(ValueError):
        Ledger(spark, str(tmp_path / "store"), struct(pair_id=T.StringType(), m=T.StringType()), "m")
    again.close()
    assert not [t for t in spark.catalog.listTables() if t.name in again._defined]


def test_stored_side_is_neither_shuffled_nor_broadcast(spark, tmp_path):
    store = Ledger(spark, str(tmp_path / "store"), ROWS, buckets=8)
    store.append(spark.range(50).selectExpr("cast(id as string) as pair_id", "id as n"))
    store.append(spark.range(50, 80).selectExpr("cast(id as string) as pair_id", "id as n"))
    new = store.missing(spark.range(70, 100).selectExpr("cast(id as string) as pair_id", "id as n"))
    assert sorted(r.n for r in new.collect()) == list(range(80, 100))
    plan = executed_plan(new).split("== Initial Plan ==")[0]
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastExchange" not in plan


def test_a_lost_run_is_not_read_and_its_rows_are_stored_by_the_next(spark, tmp_path):
    store = Ledger(spark, str(tmp_path / "store"), ROWS, buckets=4)
    store.append(frame(spark, [("a", 1)]))
    store._write(frame(spark, [("b", 2)]))  # everything but the commit
    assert content(store) == [("a", 1)]
    assert store.append(frame(spark, [("a", 1), ("b", 2)])) == 1
    assert content(store) == [("a", 1), ("b", 2)]
    assert store.drop_lost_runs() == 1 and content(store) == [("a", 1), ("b", 2)]


def test_two_runs_at_a_time_store_a_key_once(spark, tmp_path, monkeypatch):
    one = Ledger(spark, str(tmp_path / "store"), ROWS, buckets=4)
    two = Ledger(spark, str(tmp_path / "store"), ROWS, buckets=4)
    one.append(frame(spark, [("a", 1)]))
    written = one._write
    done = []

    def overtaken(todo):
        out = written(todo)
        if not done:  # the other run commits between this one's writing and its commit
            done.append(two.append(frame(spark, [("b", 20), ("c", 30)])))
        return out

    monkeypatch.setattr(one, "_write", overtaken)
    assert one.append(frame(spark, [("a", 1), ("b", 2), ("d", 4), (None, 5)])) == 2
    assert done == [2]
    assert content(one) == [("None", 5), ("a", 1), ("b", 20), ("c", 30), ("d", 4)]
    assert [c.number for c in one.commits()] == [0, 1, 2]
    assert one.drop_lost_runs() == 0


def test_triage_into_a_ledger_resumes(spark, tmp_path):
    messages, corpus = V.messages(spark, SF_DIR), V.corpus(spark, SF_DIR)
    keyed = messages.where("pair_id IS NOT NULL")
    store = Ledger(spark, str(tmp_path / "store"), PREDICTIONS, buckets=4)
    n = keyed.count()
    first = triage_ledger(keyed.where("vec_id < 200"), corpus, stored_answers(), store)
    assert 0 < first < n
    assert triage_ledger(keyed, corpus, stored_answers(), store) == n - first
    assert triage_ledger(keyed, corpus, stored_answers(), store) == 0
    assert store.rows().count() == store.rows().select("pair_id").distinct().count() == n


# --- answers -----------------------------------------------------------------------------------------

class Flaky:
    """A model that fails as told: by prompt, so many times."""

    def __init__(self, failures):
        self.failures, self.calls = dict(failures), []

    def __call__(self, rows):
        self.calls.append(list(rows["prompt"]))
        for prompt in rows["prompt"]:
            if self.failures.get(prompt, 0) > 0:
                self.failures[prompt] -= 1
                raise ConnectionError(prompt)
        return pd.DataFrame({"answer": [p.upper() for p in rows["prompt"]]})


def test_retry_waits_longer_and_records_what_always_fails():
    waits = []
    model = Flaky({"twice": 2, "always": 99})
    got = A.ask_with_retry(model, pd.DataFrame({"prompt": ["fine", "twice", "always"]}),
                           A.Retry(attempts=4, wait=0.5, longest=1.5), sleep=waits.append)
    assert list(got["answer"]) == ["FINE", "TWICE", None]
    assert list(got["attempts"]) == [2, 3, 4]
    assert got["error"][2] == "ConnectionError: always" and got["error"][0] is None
    assert waits == [0.5, 0.5, 1.0, 0.5, 1.0, 1.5]
    assert len(model.calls[0]) == 3 and all(len(c) == 1 for c in model.calls[1:])
    calm = Flaky({})
    assert list(A.ask_with_retry(calm, pd.DataFrame({"prompt": ["a", "b"]}), A.Retry())["attempts"]) == [1, 1]
    assert len(calm.calls) == 1


def counting_model(folder, fail=None):
    """Writes a file for each prompt it answers, so that calls can be counted across workers."""
    def answer(prompt):
        import hashlib
        import uuid
        if prompt == fail:
            raise ConnectionError("down")
        name = hashlib.sha256(prompt.encode()).hexdigest()[:12]
        open(f"{folder}/{name}-{uuid.uuid4().hex}", "w").close()
        return f"answer to {prompt}"
    return text_model(answer)


def test_equal_prompts_are_asked_once_and_only_missing_ones_later(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    book = A.AnswerBook(spark, str(tmp_path / "book"), A.Retry(attempts=2, wait=0.01), portion=4)
    rows = spark.createDataFrame([(i, f"p{i % 7}" if i % 10 else None) for i in range(60)], "id int, prompt string")
    got = book.score(rows, "m", counting_model(calls), F.col("id") != 3).collect()
    assert len(got) == 60
    for r in got:
        want = f"answer to {r.prompt}" if r.prompt and r.id != 3 else None
        assert r.answer == want
    assert len(list(calls.iterdir())) == 7
    assert len(book.ledger.commits()) == 2  # seven prompts in portions of about four
    # The same prompts again, and two more; another model has answers of its own.
    more = spark.createDataFrame([(1, "p1"), (2, "new"), (3, "newer")], "id int, prompt string")
    assert book.complete(more.select("prompt"), "m", counting_model(calls)) == 2
    assert len(list(calls.iterdir())) == 9
    assert book.complete(more.select("prompt"), "other", counting_model(calls)) == 3


def test_an_interrupted_run_goes_on_with_what_it_has_not_committed(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()
    book = A.AnswerBook(spark, str(tmp_path / "book"), portion=5)
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(20)], "prompt string")
    append, done = book.ledger.append, []

    def dies(df):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(append(df))
        return done[-1]

    monkeypatch.setattr(book.ledger, "append", dies)
    with pytest.raises(KeyboardInterrupt):
        book.complete(prompts, "m", counting_model(calls))
    monkeypatch.undo()
    assert book.answers().count() == sum(done) < 20
    again = A.AnswerBook(spark, str(tmp_path / "book"), portion=5)
    assert again.complete(prompts, "m", counting_model(calls)) == 20 - sum(done)
    assert len(list(calls.iterdir())) == 20 == again.answers().count()


def test_a_failing_prompt_is_unparseable_and_fails_nothing_else(spark, tmp_path):
    rows = spark.createDataFrame([("a", "my parcel is late"), ("b", "call the police now"), ("c", "bad one")],
                                 "pair_id string, customer_text string")
    calls = tmp_path / "calls"
    calls.mkdir()

    def answer(prompt):
        if "bad one" in prompt:
            raise ConnectionError("down")
        open(f"{calls}/{abs(hash(prompt))}", "w").close()
        return '{"intent": "order_delivery", "confidence": 0.9, "rationale": "r"}'

    book = A.AnswerBook(spark, str(tmp_path / "book"), A.Retry(attempts=2, wait=0.01))
    for _ in range(2):
        got = {r.pair_id: r.intent for r in classify(rows, text_model(answer), score=book.scorer("m")).collect()}
        assert got == {"a": "order_delivery", "b": "safety_incident", "c": "other"}
    assert len(list(calls.iterdir())) == 1
    lost = book.answers().where("answer IS NULL").collect()
    assert len(lost) == 1 and lost[0].attempts == 2 and "down" in lost[0].error


# --- stream ------------------------------------------------------------------------------------------

def test_a_batch_reads_nothing_that_earlier_batches_wrote(spark, tmp_path):
    messages, corpus = V.messages(spark, SF_DIR), V.corpus(spark, SF_DIR)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    keyed = messages.where("pair_id IS NOT NULL")
    half = keyed.where("vec_id < 250").unionByName(messages.where("pair_id IS NULL").limit(4))

    def run():
        stream = spark.readStream.schema(messages.schema).parquet(source)
        triage_stream(stream, corpus, stored_answers(), out, state).awaitTermination()

    half.coalesce(1).write.parquet(source)
    run()
    first = stored_decisions(spark, out)
    assert first.count() == half.count()
    n_first = first.where("pair_id IS NOT NULL").count()
    kept = tmp_path / "elsewhere"
    shutil.move(out, kept)  # nothing of it is left to be read
    (tmp_path / "out").mkdir()
    # All messages, those decided before among them, and the keyless ones once more.
    keyed.unionByName(messages.where("pair_id IS NULL").limit(4)).coalesce(1).write.mode("append").parquet(source)
    run()
    second = stored_decisions(spark, out)
    assert second.where("pair_id IS NOT NULL").count() == keyed.count() - n_first
    assert second.where("pair_id IS NULL").count() == 4
    run()
    assert stored_decisions(spark, out).count() == second.count()
    with pytest.raises(ValueError):
        stream = spark.readStream.schema(messages.schema).parquet(source)
        triage_stream(stream, corpus, stored_answers(), out, str(tmp_path / "new-state"))


def test_keys_are_state_of_the_query(spark, tmp_path):
    rows = frame(spark, [("a", 1), ("a", 2), (None, 3), (None, 4), ("", 5), ("b", 6)])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = once_per_key(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate [pair_id" in plan
    batch = once_per_key(rows).collect()
    assert sorted(str(r.pair_id) for r in batch) == ["", "None", "None", "a", "b"]
