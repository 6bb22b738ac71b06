"""Whole triage: batch, resumed and streamed."""

import pytest
from pyspark.sql import functions as F

from replyloom import constants as K
from replyloom.catalog import views as V
from replyloom.operators.evaluate import leak_count
from replyloom.operators.retrieve import knn_blocked, knn_lsh
from replyloom.operators.scoring import text_model
from replyloom.plans.triage import model_classifier, stored_answers, triage, triage_batch
from replyloom.schemas import PREDICTIONS
from replyloom.sources.io import read_store
from replyloom.streaming.triage_stream import triage_stream

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(str(r.asDict()) for r in df.select(*PREDICTIONS.names).collect())


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """The derived messages and corpus as written tables, as a user would keep them."""
    base = tmp_path_factory.mktemp("triage")
    for name, df in (("messages", V.messages(spark, SF_DIR)), ("corpus", V.corpus(spark, SF_DIR))):
        df.repartition(3, "vec_id").write.parquet(str(base / name))
    return spark.read.parquet(str(base / "messages")), spark.read.parquet(str(base / "corpus")), base


@pytest.fixture(scope="module")
def decided(inputs):
    messages, corpus, _ = inputs
    return triage(messages, corpus, stored_answers(), min_similarity=0.25).cache()


def test_every_message_is_decided_once(inputs, decided):
    messages, _, _ = inputs
    assert decided.count() == messages.count()
    assert [f.name for f in decided.schema.fields] == PREDICTIONS.names
    assert leak_count(decided).first()["n_leaks"] == 0


def test_gate(decided):
    gated = decided.where(F.col("intent") == K.SAFETY).collect()
    assert gated
    for r in gated:
        assert r["reply"] is None and r["grounded_on"] == [] and r["top_similarity"] == 0.0
        assert r["ranking_method"] == "skipped" and r["escalate"]
        assert r["escalation_reasons"] == [
            "intent 'safety_incident' is never auto-drafted, routed directly to a human agent"]


def test_drafts_and_reasons(decided):
    for r in decided.where(F.col("intent") != K.SAFETY).collect():
        assert len(r["grounded_on"]) == 3 and r["reply"].startswith("reply ")
        assert r["escalate"] == (r["escalation_reasons"] != [K.REASON_AUTO])


@pytest.mark.parametrize("search,options", [
    (knn_blocked, {"block_rows": 200}), (knn_lsh, {"bits": 1, "tables": 16})])
def test_other_searches_fit_in(inputs, decided, search, options):
    messages, corpus, _ = inputs
    other = triage(messages, corpus, stored_answers(), search=search, min_similarity=0.25, **options)
    if search is knn_blocked:
        assert rows(other) == rows(decided)
    else:
        assert other.count() == decided.count()


def test_self_retrieval_when_allowed(inputs):
    messages, corpus, _ = inputs
    out = triage(messages, corpus, stored_answers(), mode=K.METHOD_ONE_STAGE, exclude_self=False)
    leaks = leak_count(out.where("intent <> 'safety_incident' AND pair_id IS NOT NULL")).first()
    assert leaks["n_leaks"] == leaks["n_rows"] > 0
    assert out.where("ranking_method = 'embedding_only'").count() > 0


def test_models_classify_and_draft(inputs, spark):
    messages, corpus, _ = inputs
    classifier = model_classifier(
        text_model(lambda p: '{"intent": "general_inquiry", "confidence": 0.9, "rationale": "r"}'))
    out = triage(messages.select("pair_id", "customer_text", "embedding"), corpus, classifier,
                 drafter=text_model(lambda p: f"draft from {p.count(' / Answered: ')} cases"), min_similarity=0.0)
    kept = out.where("intent = 'general_inquiry'")
    assert kept.select("reply").distinct().collect()[0][0] == "draft from 3 cases"
    assert kept.where("escalate").isEmpty()


def test_equal_rows_are_all_answered(inputs, spark):
    messages, corpus, _ = inputs
    few = messages.where("vec_id IN (2, 3, 37)")
    many = few.unionByName(few).unionByName(few)
    out = triage(many, corpus, stored_answers())
    assert out.count() == 9
    assert out.distinct().count() == 3


def test_batch_resumes(inputs, decided, spark):
    messages, corpus, base = inputs
    out = str(base / "predictions")
    keyed = messages.where("pair_id IS NOT NULL")
    triage_batch(keyed.where("vec_id < 200"), corpus, stored_answers(), out, min_similarity=0.25)
    triage_batch(keyed, corpus, stored_answers(), out, min_similarity=0.25)
    triage_batch(keyed, corpus, stored_answers(), out, min_similarity=0.25)
    stored = read_store(spark, out, PREDICTIONS)
    assert rows(stored) == rows(decided.where("pair_id IS NOT NULL"))


def test_stream_equals_batch_and_restarts_clean(inputs, decided, spark):
    messages, corpus, base = inputs
    out, state, source = str(base / "out"), str(base / "state"), str(base / "messages")

    def run():
        stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 2).parquet(source)
        triage_stream(stream, corpus, stored_answers(), out, state, min_similarity=0.25).awaitTermination()
        return spark.read.parquet(out)

    assert rows(run()) == rows(decided)
    assert rows(run()) == rows(decided)                     # nothing new: nothing added
    # A lost commit record makes the last batch run again.
    last = max((base / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for path in (last, last.with_name(f".{last.name}.crc")):
        path.unlink(missing_ok=True)
    assert rows(run()) == rows(decided)


def test_equal_texts_share_no_draft_across_the_gate(spark, inputs):
    """Keyless messages of one text: each row is decided by its own answer and vector."""
    _, corpus, _ = inputs
    vectors = [r["embedding"] for r in corpus.orderBy("vec_id").limit(2).collect()]
    safe = '{"intent": "general_inquiry", "confidence": 0.9, "rationale": "r"}'
    gated = '{"intent": "safety_incident", "confidence": 0.9, "rationale": "r"}'
    messages = spark.createDataFrame(
        [(None, "hello there", v, a, None) for v in vectors for a in (safe, gated)],
        "pair_id string, customer_text string, embedding array<float>, first_answer string, "
        "second_answer string")
    got = triage(messages, corpus, stored_answers(), mode=K.METHOD_ONE_STAGE, k=1).collect()
    assert len(got) == 4
    for r in got:
        if r["intent"] == K.SAFETY:
            assert r["reply"] is None and r["grounded_on"] == [] and r["top_similarity"] == 0.0
    drafted = [r for r in got if r["intent"] != K.SAFETY]
    assert len({tuple(r["grounded_on"]) for r in drafted}) == 2
    assert {r["top_similarity"] for r in drafted} == {1.0}
