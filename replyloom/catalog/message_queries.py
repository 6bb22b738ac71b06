"""Queries on messages: sources, cleaning, filters, pairing, samples, rules, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from replyloom import constants as K, schemas
from replyloom.catalog import views as V
from replyloom.catalog.registry import query
from replyloom.functions import answers as A, prompts as P, rules as R, text as X
from replyloom.operators import classify as C, pairs, sampling, scoring
from replyloom.operators.answers import AnswerBook
from replyloom.operators.keys import first_by_key, join_gold_pred, unprocessed
from replyloom.session import scratch_path
from replyloom.sources import io
from replyloom.sources.ledger import Ledger

# --- SQL fragments -------------------------------------------------------------------------

_WS = (r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
       r"\x{205f}\x{3000}")


def handles_sql(c: str) -> str:
    return rf"regexp_replace({c}, '@[\p{{L}}\p{{N}}_]+', '', 'g')"


def urls_sql(c: str) -> str:
    return rf"regexp_replace({c}, 'https?://[^{_WS}]+', '', 'g')"


def signature_sql(c: str) -> str:
    return rf"regexp_replace({c}, '[{_WS}]*\^[A-Za-z]{{1,3}}[{_WS}]*$', '')"


def squeeze_sql(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[{_WS}]+', ' ', 'g'))"


def clean_sql(c: str, is_reply: bool = False) -> str:
    out = urls_sql(handles_sql(c))
    return squeeze_sql(signature_sql(out) if is_reply else out)


def ratio_sql(c: str) -> str:
    foreign = rf"length(regexp_replace({c}, '[^\x{{300}}-\x{{10FFFF}}]', '', 'g'))"
    return f"CASE WHEN length({c}) = 0 THEN 0.0 ELSE {foreign} / CAST(length({c}) AS DOUBLE) END"


def first_sql(source: str, keys: str, order: str, name: str) -> str:
    order = ", ".join(f"{c} NULLS FIRST" for c in order.split(", "))
    return (f"{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER "
            f"(PARTITION BY {keys} ORDER BY {order}) = 1)")


def joined_sql(source: str, order: str, how: str = "") -> tuple[str, ...]:
    """The CTEs ``parents`` and ``joined``: replies of the brand beside their parents."""
    return (
        first_sql(source, "tweet_id", order, "parents"),
        f"""joined AS (
          SELECT r.tweet_id AS brand_tweet_id, r.in_response_to_tweet_id AS parent_id,
            p.tweet_id AS customer_tweet_id, p.inbound AS parent_inbound, p.created_at,
            {clean_sql("p.text")} AS customer_text, {clean_sql("r.text", True)} AS brand_reply
          FROM (SELECT * FROM {source} WHERE author_id = '{V.BRAND}' AND NOT inbound) r
          {how} JOIN parents p ON r.in_response_to_tweet_id = p.tweet_id)""",
        "pairs AS (SELECT customer_tweet_id || '_' || brand_tweet_id AS pair_id, "
        "customer_tweet_id, brand_tweet_id, customer_text, brand_reply, created_at FROM joined "
        "WHERE coalesce(parent_inbound, FALSE) AND length(customer_text) >= 3 "
        f"AND length(brand_reply) >= 3 AND {ratio_sql('customer_text')} <= 0.3)",
    )


_TWEETS = (V.TWEETS_SQL,)
_PAIRED = (V.TWEETS_SQL, *joined_sql("tweets", "seq"))
_MESSAGE_COLS = ", ".join(schemas.MESSAGES.names)

# --- sources and sinks -----------------------------------------------------------------------


@query("s1_read_messages_csv", f"SELECT {_MESSAGE_COLS} FROM tweets", _TWEETS)
def s1(spark, sf_dir):
    path = scratch_path(spark, "messages-csv")
    (V.tweets(spark, sf_dir).select(*schemas.MESSAGES.names).write
     .options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
              ignoreTrailingWhiteSpace=False).csv(path))
    return io.read_messages_csv(spark, path)


_PAIR_COLS = ", ".join(schemas.PAIRS.names)


@query("s2_s3_jsonl_round_trip", f"SELECT {_PAIR_COLS} FROM pairs", _PAIRED)
def s2(spark, sf_dir):
    path = scratch_path(spark, "pairs-jsonl")
    io.write_jsonl(_pairs(spark, sf_dir), path, allow_empty=False)
    return io.read_jsonl(spark, path, schemas.PAIRS)


@query("s4_corpus_round_trip",
       f"SELECT pair_id, customer_text, '{K.DEFAULT_ENCODER}' AS model_name, "
       "round(list_sum(embedding), 6) AS vector_sum FROM corpus", (V.CORPUS_SQL,))
def s4(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    io.save_corpus(V.corpus(spark, sf_dir), path, K.DEFAULT_ENCODER)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return io.load_corpus(spark, path).select(
        "pair_id", "customer_text", "model_name", F.round(total, 6).alias("vector_sum"))


@query("s5_append_new_twice",
       "SELECT pair_id, count(*) AS n_stored FROM ("
       "SELECT pair_id FROM pairs UNION ALL SELECT pair_id FROM (SELECT CASE WHEN vec_id % 37 = 0 "
       "THEN NULL ELSE pair_id END AS pair_id FROM corpus) UNION ALL SELECT CAST(NULL AS VARCHAR) "
       "FROM corpus WHERE vec_id % 37 = 0) GROUP BY pair_id", (*_PAIRED, V.CORPUS_SQL))
def s5(spark, sf_dir):
    path = scratch_path(spark, "append")
    paired = _pairs(spark, sf_dir).select("pair_id")
    other = V.messages(spark, sf_dir).select("pair_id")
    for rows in (paired, other, paired.unionByName(other)):
        io.append_new(rows, path)
    stored = io.read_store(spark, path, schemas.struct(pair_id=schemas._STR))
    return stored.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_stored"))


# --- text columns ------------------------------------------------------------------------------

_BOTH_TEXTS = ("texts AS (SELECT text FROM tweets "
               "UNION ALL SELECT text FROM documents)",)


def _texts(spark, sf_dir) -> DataFrame:
    """Messages and whole documents."""
    return (V.tweets(spark, sf_dir).select("text")
            .unionByName(V.table(spark, sf_dir, "documents").select("text")))


def _text_query(name: str, sql: str, column) -> None:
    @query(name, f"SELECT {sql} AS out FROM texts", _TWEETS + _BOTH_TEXTS)
    def run(spark, sf_dir):
        return _texts(spark, sf_dir).select(column().alias("out"))


_text_query("x1_strip_handles", handles_sql("text"), lambda: X.strip_handles("text"))
_text_query("x2_strip_urls", urls_sql("text"), lambda: X.strip_urls("text"))
_text_query("x3_strip_signature", signature_sql("text"), lambda: X.strip_signature("text"))
_text_query("x4_squeeze_ws", squeeze_sql("text"), lambda: X.squeeze_ws("text"))
_text_query("x1_x4_clean_text", clean_sql("text", True), lambda: X.clean_text("text", True))
_text_query("x5_non_latin_ratio", f"round({ratio_sql('text')}, 6)",
            lambda: F.round(X.non_latin_ratio("text"), 6))


@query("x5_f5_latin_script_only", f"SELECT tweet_id, text FROM tweets WHERE {ratio_sql('text')} <= 0.3",
       _TWEETS)
def x5(spark, sf_dir):
    return V.tweets(spark, sf_dir).where(X.is_latin_script("text")).select("tweet_id", "text")


@query("x6_fmt2", "SELECT printf('%.2f', l_extendedprice / l_quantity) AS unit_price, "
                  "printf('%.2f', l_discount * l_tax) AS product FROM lineitem")
def x6(spark, sf_dir):
    return V.table(spark, sf_dir, "lineitem").select(
        X.fmt2(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        X.fmt2(F.col("l_discount") * F.col("l_tax")).alias("product"))


# --- filters, pairing ---------------------------------------------------------------------------

def _pairs(spark, sf_dir) -> DataFrame:
    return pairs.build_pairs(V.tweets(spark, sf_dir), V.BRAND, V.TWEETS_ORDER)


@query("f1_brand_messages", f"SELECT tweet_id, seq, text FROM tweets WHERE author_id = '{V.BRAND}' "
                            "AND NOT inbound", _TWEETS)
def f1(spark, sf_dir):
    return pairs.brand_messages(V.tweets(spark, sf_dir), V.BRAND).select("tweet_id", "seq", "text")


@query("f2_has_parent", "SELECT seq, in_response_to_tweet_id FROM tweets "
                        "WHERE in_response_to_tweet_id IS NOT NULL", _TWEETS)
def f2(spark, sf_dir):
    return pairs.has_parent(V.tweets(spark, sf_dir)).select("seq", "in_response_to_tweet_id")


@query("f3_j1_join_parent",
       "SELECT brand_tweet_id, customer_tweet_id, created_at, customer_text, brand_reply FROM joined "
       "WHERE parent_inbound", _PAIRED)
def f3(spark, sf_dir):
    return pairs.join_parent(V.tweets(spark, sf_dir), V.BRAND, V.TWEETS_ORDER).select(
        "brand_tweet_id", "customer_tweet_id", "created_at", "customer_text", "brand_reply")


@query("f4_min_length", "SELECT seq, out FROM (SELECT seq, " + clean_sql("text") +
       " AS out FROM tweets) WHERE length(out) >= 3", _TWEETS)
def f4(spark, sf_dir):
    return V.tweets(spark, sf_dir).select("seq", X.clean_text("text").alias("out")).where(
        X.long_enough("out"))


@query("f6_build_pairs", f"SELECT {_PAIR_COLS} FROM pairs", _PAIRED)
def f6(spark, sf_dir):
    return _pairs(spark, sf_dir)


_LARGE = (V.TWEETS_LARGE_SQL, *joined_sql("tweets_large", "tweet_id, created_at, text"))


@query("f6_build_pairs_large", f"SELECT {_PAIR_COLS} FROM pairs", _LARGE)
def f6_large(spark, sf_dir):
    return pairs.build_pairs(V.tweets_large(spark, sf_dir), V.BRAND, V.TWEETS_LARGE_ORDER)


@query("f6_build_pairs_shuffled", f"SELECT {_PAIR_COLS} FROM pairs", _LARGE)
def f6_shuffled(spark, sf_dir):
    """The same pairs when the messages come in another order."""
    return pairs.build_pairs(V.tweets_large(spark, sf_dir).repartition("text"), V.BRAND,
                             V.TWEETS_LARGE_ORDER)


@query("f6_build_pairs_deduplicated", f"SELECT {_PAIR_COLS} FROM pairs",
       (V.TWEETS_LARGE_SQL, first_sql("tweets_large", "tweet_id", "tweet_id, created_at, text", "once"),
        *joined_sql("once", "tweet_id, created_at, text")))
def f6_dedupe(spark, sf_dir):
    return pairs.build_pairs(V.tweets_large(spark, sf_dir), V.BRAND, V.TWEETS_LARGE_ORDER, dedupe=True)


_OUTCOME_SQL = f"""
SELECT outcome, count(*) AS n_replies FROM (
  SELECT CASE WHEN parent_id IS NULL THEN 'no_parent_id'
    WHEN customer_tweet_id IS NULL THEN 'parent_missing'
    WHEN NOT coalesce(parent_inbound, FALSE) THEN 'parent_not_customer'
    WHEN NOT coalesce(length(customer_text) >= 3 AND length(brand_reply) >= 3, FALSE) THEN 'too_short'
    WHEN {ratio_sql("customer_text")} > 0.3 THEN 'non_latin' ELSE 'kept' END AS outcome
  FROM joined) GROUP BY outcome"""


@query("f7_drop_report", _OUTCOME_SQL, (V.TWEETS_SQL, *joined_sql("tweets", "seq", "LEFT")[:2]))
def f7(spark, sf_dir):
    return pairs.drop_report(V.tweets(spark, sf_dir), V.BRAND, V.TWEETS_ORDER)


@query("f7_drop_report_large", _OUTCOME_SQL,
       (V.TWEETS_LARGE_SQL, *joined_sql("tweets_large", "tweet_id, created_at, text", "LEFT")[:2]))
def f7_large(spark, sf_dir):
    return pairs.drop_report(V.tweets_large(spark, sf_dir), V.BRAND, V.TWEETS_LARGE_ORDER)


@query("a1_brand_volume",
       "SELECT author_id AS brand_handle, count(*) AS tweet_count FROM tweets_large WHERE NOT inbound "
       "GROUP BY author_id ORDER BY tweet_count DESC, brand_handle LIMIT 40", (V.TWEETS_LARGE_SQL,))
def a1(spark, sf_dir):
    return pairs.brand_volume(V.tweets_large(spark, sf_dir))


@query("a6_first_by_key", "SELECT tweet_id, seq, author_id, inbound FROM firsts",
       (V.TWEETS_SQL, first_sql("tweets", "tweet_id", "seq", "firsts")))
def a6(spark, sf_dir):
    return first_by_key(V.tweets(spark, sf_dir), ["tweet_id"], V.TWEETS_ORDER).select(
        "tweet_id", "seq", "author_id", "inbound")


@query("j3_unprocessed",
       "SELECT pair_id, vec_id FROM (SELECT CASE WHEN vec_id % 37 = 0 THEN NULL ELSE pair_id END AS "
       "pair_id, vec_id FROM corpus) m WHERE pair_id IS NULL OR NOT EXISTS (SELECT 1 FROM labels l "
       "WHERE 'p' || l.doc_id = m.pair_id)", (V.CORPUS_SQL,))
def j3(spark, sf_dir):
    done = V.table(spark, sf_dir, "labels").select(F.concat(F.lit("p"), "doc_id").alias("pair_id"))
    return unprocessed(V.messages(spark, sf_dir).select("pair_id", "vec_id"), done)


# --- sampling -------------------------------------------------------------------------------------

_SAMPLE_N = 150


def _sample_ctes(n: int, view: str, order: str, hashed: str, parents: bool = False) -> tuple[str, ...]:
    order_nf = ", ".join(f"{c} NULLS FIRST" for c in order.split(", "))
    keep = (f"""UNION ALL SELECT *, 2 AS tier FROM hashed WHERE author_id <> '{V.BRAND}' AND tweet_id IN
        (SELECT in_response_to_tweet_id FROM hashed WHERE author_id = '{V.BRAND}' AND NOT inbound)"""
            if parents else "")
    return (
        f"hashed AS (SELECT *, md5({hashed}) AS pick FROM {view})",
        f"chosen AS (SELECT *, 0 AS tier FROM hashed WHERE author_id = '{V.BRAND}' UNION ALL "
        f"(SELECT *, 1 AS tier FROM hashed WHERE author_id <> '{V.BRAND}' "
        f"ORDER BY pick, {order_nf} LIMIT {n}) {keep})",
        f"sampled AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY "
        f"tier, CASE WHEN tier = 1 THEN pick END, {order_nf}) = 1)",
    )


_TWEETS_HASH = "concat_ws(':', '42', CAST(tweet_id AS VARCHAR), CAST(seq AS VARCHAR))"
_LARGE_HASH = "concat_ws(':', '42', CAST(tweet_id AS VARCHAR), CAST(tweet_id AS VARCHAR), created_at, text)"


@query("p1_brand_biased_sample", "SELECT tweet_id, seq FROM sampled",
       (V.TWEETS_SQL, *_sample_ctes(_SAMPLE_N, "tweets", "seq", _TWEETS_HASH)))
def p1(spark, sf_dir):
    return pairs.brand_biased_sample(V.tweets(spark, sf_dir), V.BRAND, _SAMPLE_N,
                                     V.TWEETS_ORDER).select("tweet_id", "seq")


@query("p1_sample_keeping_parents", "SELECT tweet_id, seq FROM sampled",
       (V.TWEETS_SQL, *_sample_ctes(_SAMPLE_N, "tweets", "seq", _TWEETS_HASH, True)))
def p1_parents(spark, sf_dir):
    return pairs.brand_biased_sample(V.tweets(spark, sf_dir), V.BRAND, _SAMPLE_N, V.TWEETS_ORDER,
                                     keep_parents=True).select("tweet_id", "seq")


@query("p1_large_sample_by_rank", "SELECT tweet_id, text FROM sampled",
       (V.TWEETS_LARGE_SQL,
        *_sample_ctes(20000, "tweets_large", "tweet_id, created_at, text", _LARGE_HASH)))
def p1_large(spark, sf_dir):
    """A large sample, cut by counts of the random order's first digits."""
    return pairs.brand_biased_sample(V.tweets_large(spark, sf_dir), V.BRAND, 20000,
                                     V.TWEETS_LARGE_ORDER).select("tweet_id", "text")


_DISTANCE = (
    V.CORPUS_SQL,
    "spread AS (SELECT pair_id, cluster, unnest(embedding) AS x, "
    "unnest(range(len(embedding))) AS dim FROM corpus)",
    "centres AS (SELECT cluster, dim, avg(x) AS m FROM spread GROUP BY cluster, dim)",
    "measured AS (SELECT pair_id, s.cluster, sqrt(sum((x - m) * (x - m))) AS distance "
    "FROM spread s JOIN centres c ON s.cluster = c.cluster AND s.dim = c.dim "
    "GROUP BY pair_id, s.cluster)",
)


@query("p3_centroid_distance", "SELECT pair_id, cluster, round(distance, 6) AS distance FROM measured",
       _DISTANCE)
def p3(spark, sf_dir):
    return sampling.centroid_distance(V.corpus(spark, sf_dir)).select(
        "pair_id", "cluster", F.round("distance", 6).alias("distance"))


@query("p2_f11_cluster_stratified_sample", """
SELECT c.pair_id, customer_text, brand_reply, '' AS gold_intent,
  CAST(NULL AS BOOLEAN) AS gold_escalate, '' AS gold_escalate_reason, '' AS notes
FROM corpus c JOIN chosen USING (pair_id) ORDER BY c.pair_id LIMIT 100""", (
    *_DISTANCE,
    "picks AS (SELECT pair_id FROM corpus QUALIFY row_number() OVER (PARTITION BY cluster "
    "ORDER BY md5('42:' || pair_id), pair_id) <= 5)",
    "chosen AS (SELECT pair_id FROM picks UNION ALL (SELECT pair_id FROM measured WHERE pair_id NOT IN "
    "(SELECT pair_id FROM picks) ORDER BY round(distance, 6) DESC, pair_id LIMIT 15))"))
def p2(spark, sf_dir):
    return sampling.label_template(sampling.cluster_stratified_sample(V.corpus(spark, sf_dir), 100))


_GOLD = (V.GOLDEN_SQL, V.PREDICTIONS_SQL)


@query("r6_holdout_split", "SELECT seq, rn <= CAST(floor(0.7 * n) AS BIGINT) AS is_train FROM (SELECT "
       "seq, row_number() OVER (ORDER BY seq) AS rn, count(*) OVER () AS n FROM golden)", _GOLD)
def r6(spark, sf_dir):
    return sampling.holdout_split(V.golden(spark, sf_dir).select("seq"), ("seq",))


# --- rules ----------------------------------------------------------------------------------------

def keyword_sql(c: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({c}), {V.quoted(t)})" for t in terms) + f" THEN '{intent}'"
        for intent, terms in K.LEXICON)
    return f"CASE {whens} ELSE 'other' END"


def safety_sql(c: str) -> str:
    return "coalesce(" + " OR ".join(
        f"contains(lower({c}), '{t}')" for t in K.SAFETY_TRIGGERS) + ", FALSE)"


def in_sql(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("d1_keyword_intent", f"SELECT tweet_id, text, {keyword_sql('text')} AS intent FROM tweets_large",
       (V.TWEETS_LARGE_SQL,))
def d1(spark, sf_dir):
    return V.tweets_large(spark, sf_dir).select("tweet_id", "text", R.keyword_intent("text").alias("intent"))


@query("d1_keyword_intent_documents", f"SELECT doc_id, {keyword_sql('text')} AS intent FROM documents")
def d1_documents(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", R.keyword_intent("text").alias("intent"))


@query("d2_safety_rule",
       f"SELECT seq, '{K.SAFETY}' AS intent, 1.0::DOUBLE AS confidence, '{K.RATIONALE_SAFETY}' AS rationale, "
       f"'{K.SOURCE_SAFETY}' AS source FROM tweets WHERE {safety_sql('text')}", _TWEETS)
def d2(spark, sf_dir):
    return (V.tweets(spark, sf_dir).select("seq", R.safety_rule("text").alias("r"))
            .where("r IS NOT NULL").select("seq", "r.*"))


@query("d3_resolve_intent",
       f"SELECT event_id, CASE WHEN event_type IN {in_sql(K.TAXONOMY)} THEN event_type ELSE 'other' END AS "
       f"as_given, CASE WHEN label IN {in_sql(K.TAXONOMY)} THEN label ELSE 'other' END AS intent "
       f"FROM (SELECT *, {V.pick_sql(K.TAXONOMY + ('weather', 'OTHER'), 'user_id')} AS label FROM events)")
def d3(spark, sf_dir):
    label = V.pick(K.TAXONOMY + ("weather", "OTHER"), F.col("user_id"))
    return V.table(spark, sf_dir, "events").select(
        "event_id", R.resolve_intent("event_type").alias("as_given"),
        R.resolve_intent(label).alias("intent"))


def reasons_sql(intent: str, conf: str, sim: str, min_conf: float, min_sim: float) -> str:
    hi, lo, si = K.REASON_HIGH_RISK, K.REASON_CONFIDENCE, K.REASON_SIMILARITY
    return (
        f"list_filter([CASE WHEN {intent} IN {in_sql(K.HIGH_RISK_INTENTS)} THEN '{hi[0]}' || {intent} || "
        f"'{hi[1]}' END, CASE WHEN {conf} < {min_conf} THEN '{lo[0]}' || printf('%.2f', {conf}) || "
        f"'{lo[1]}{min_conf}{lo[2]}' END, CASE WHEN {sim} < {min_sim} THEN '{si[0]}' || "
        f"printf('%.2f', {sim}) || '{si[1]}{min_sim}{si[2]}' END], lambda x: x IS NOT NULL)")


def _decision_query(name: str, min_similarity: float) -> None:
    reasons = reasons_sql("intent", "conf", "sim", K.MIN_CONFIDENCE, min_similarity)

    @query(name, f"""
    SELECT pair_id, intent, len(r) > 0 AS escalate,
      CASE WHEN len(r) > 0 THEN array_to_string(r, '|') ELSE '{K.REASON_AUTO}' END AS reasons
    FROM (SELECT *, {reasons} AS r FROM (SELECT pair_id, intent,
      coalesce(CASE WHEN l_tax = 0.08 THEN NULL ELSE round(l_quantity / 50, 3) END, 0.0) AS conf,
      coalesce(top_similarity, 0.0) AS sim FROM (SELECT *, l_quantity AS q FROM predictions)))""",
           (V.PREDICTIONS_SQL,))
    def run(spark, sf_dir):
        df = V.predictions(spark, sf_dir).withColumn(
            "conf", F.when(F.col("l_tax") == 0.08, F.lit(None))
            .otherwise(F.round(F.col("l_quantity") / 50, 3)))
        verdict = R.decide_escalation("intent", "conf", "top_similarity",
                                      min_similarity=min_similarity)
        return df.withColumn("v", verdict).select(
            "pair_id", "intent", F.col("v.escalate").alias("escalate"),
            F.array_join("v.escalation_reasons", "|").alias("reasons"))


_decision_query("d7_decide_escalation", K.MIN_SIMILARITY)
_decision_query("d7_decide_escalation_low_floor", 0.2)

# --- answers --------------------------------------------------------------------------------------

_TRIM = rf"'^[{_WS}]+|[{_WS}]+$', '', 'g'"


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, {_TRIM})"


def fences_sql(c: str) -> str:
    out = rf"regexp_replace({c}, '^(?i:```json)[{_WS}]*', '')"
    out = rf"regexp_replace({out}, '^```[{_WS}]*', '')"
    return trim_sql(f"regexp_replace({out}, '```$', '')")


def object_sql(body: str) -> str:
    return f"coalesce(CASE WHEN json_valid({body}) THEN json_type({body}) = 'OBJECT' END, FALSE)"


def number_sql(body: str, key: str, kind: str = "DOUBLE") -> str:
    return (f"CASE WHEN json_type({body}, '$.{key}') IN ('DOUBLE', 'UBIGINT', 'BIGINT') "
            f"THEN CAST(json_extract({body}, '$.{key}') AS {kind}) END")


def parsed_cte(source: str, answer: str, name: str, carry: str) -> str:
    """``name``: the carried columns with intent, confidence, rationale read from ``answer``."""
    raw, body = trim_sql(answer), fences_sql(trim_sql(answer))
    bad = f"'{K.UNPARSEABLE_PREFIX}' || substring(coalesce({raw}, ''), 1, {K.UNPARSEABLE_CHARS})"
    ok = object_sql("body")
    return f"""{name} AS (
      SELECT {carry}, CASE WHEN {ok} THEN json_extract_string(body, '$.intent') ELSE 'other' END AS intent,
        CASE WHEN {ok} THEN {number_sql("body", "confidence")} ELSE 0.0 END AS confidence,
        CASE WHEN {ok} THEN json_extract_string(body, '$.rationale') ELSE {bad} END AS rationale
      FROM (SELECT *, {body} AS body FROM {source}))"""


@query("x7_strip_fences", f"SELECT pair_id, {fences_sql('first_answer')} AS body FROM corpus",
       (V.CORPUS_SQL,))
def x7(spark, sf_dir):
    return V.corpus(spark, sf_dir).select("pair_id", A.strip_fences("first_answer").alias("body"))


@query("x8_parse_intent_json", "SELECT * FROM parsed",
       (V.CORPUS_SQL, parsed_cte("corpus", "first_answer", "parsed", "pair_id")))
def x8(spark, sf_dir):
    return V.corpus(spark, sf_dir).select(
        "pair_id", A.parse_intent_json("first_answer").alias("a")).select("pair_id", "a.*")


_JUDGE_FIELDS = schemas.JUDGE_ANSWER.names[:-1]
_JUDGE_ANSWER_SQL = V.pick_sql(V.JUDGE_ANSWERS, "vec_id")
_JUDGED_CTE = f"""judged AS (
  SELECT pair_id, {", ".join(f"CASE WHEN {object_sql('body')} THEN {number_sql('body', f, 'INT')} END AS {f}"
                             for f in _JUDGE_FIELDS)},
    CASE WHEN {object_sql('body')} THEN json_extract_string(body, '$.rationale')
         ELSE '{K.UNPARSEABLE_PREFIX}' || substring(raw, 1, {K.UNPARSEABLE_CHARS}) END AS rationale
  FROM (SELECT pair_id, {_JUDGE_ANSWER_SQL} AS raw, {fences_sql(_JUDGE_ANSWER_SQL)} AS body FROM corpus))"""


@query("x9_parse_judge_json", "SELECT * FROM judged", (V.CORPUS_SQL, _JUDGED_CTE))
def x9(spark, sf_dir):
    return V.corpus(spark, sf_dir).select(
        "pair_id", A.parse_judge_json(V.pick(V.JUDGE_ANSWERS, F.col("vec_id"))).alias("j")
    ).select("pair_id", "j.*")


def fill_sql(template: str, **values: str) -> str:
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(V.quoted(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(f"coalesce({values[name]}, '')")
    return "(" + " || ".join(parts) + ")"


_EXAMPLES = "\n".join(l + ": " + t for t, l in P.LABELLED_EXAMPLES)


def classify_prompt_sql(message: str) -> str:
    return fill_sql(P.CLASSIFY_TEMPLATE, labels=V.quoted(", ".join(K.TAXONOMY)),
                    examples=V.quoted(_EXAMPLES), message=message)


@query("x11_prompts",
       f"SELECT pair_id, {classify_prompt_sql('customer_text')} AS classify_prompt, "
       f"{fill_sql(P.REPLY_TEMPLATE, message='customer_text', examples='brand_reply')} AS reply_prompt, "
       f"{fill_sql(P.JUDGE_TEMPLATE, message='customer_text', reply='brand_reply')} AS judge_prompt "
       "FROM corpus", (V.CORPUS_SQL,))
def x11(spark, sf_dir):
    return V.corpus(spark, sf_dir).select(
        "pair_id", P.classify_prompt("customer_text").alias("classify_prompt"),
        P.reply_prompt("customer_text", "brand_reply").alias("reply_prompt"),
        P.judge_prompt("customer_text", "brand_reply").alias("judge_prompt"))


_KEPT = "pair_id, customer_text, vec_id, first_answer, second_answer"
_CLASSIFIED = (
    parsed_cte("corpus", "first_answer", "a1", _KEPT),
    parsed_cte("corpus", "second_answer", "a2", "pair_id"),
    f"""combined AS (SELECT a1.pair_id, a1.customer_text, a1.vec_id,
      coalesce(a1.intent = 'other' AND a2.intent IN {in_sql(K.TAXONOMY)}, FALSE) AS taken,
      CASE WHEN taken THEN a2.intent ELSE a1.intent END AS intent,
      CASE WHEN taken THEN a2.confidence ELSE a1.confidence END AS confidence,
      CASE WHEN taken THEN a2.rationale ELSE a1.rationale END AS rationale
      FROM a1 JOIN a2 ON a1.pair_id = a2.pair_id)""",
    f"""classified AS (SELECT pair_id, customer_text, vec_id,
      CASE WHEN safe THEN '{K.SAFETY}' WHEN intent IN {in_sql(K.TAXONOMY)} THEN intent ELSE 'other' END
        AS intent,
      CASE WHEN safe THEN 1.0 ELSE confidence END AS intent_confidence,
      CASE WHEN safe THEN '{K.RATIONALE_SAFETY}' ELSE rationale END AS intent_rationale,
      CASE WHEN safe THEN '{K.SOURCE_SAFETY}' END AS source,
      NOT safe AND taken AS reconsidered
      FROM (SELECT *, {safety_sql("customer_text")} AS safe FROM combined))""",
)
CLASSIFIED_CTES = (V.CORPUS_SQL, *_CLASSIFIED)
_CLASS_COLS = ["pair_id", "intent", "intent_confidence", "intent_rationale", "source", "reconsidered"]


@query("d4_reconsider_other",
       "SELECT pair_id, intent, confidence, rationale, taken AS reconsidered FROM combined", CLASSIFIED_CTES)
def d4(spark, sf_dir):
    parsed = V.corpus(spark, sf_dir).select("pair_id", A.parse_intent_json("first_answer").alias("first"),
                                            A.parse_intent_json("second_answer").alias("second"))
    both = C.reconsider_other(F.col("first"), F.col("second"))
    return parsed.select("pair_id", both.alias("a")).select("pair_id", "a.*")


@query("d5_classify_stored_answers", f"SELECT {', '.join(_CLASS_COLS)} FROM classified", CLASSIFIED_CTES)
def d5(spark, sf_dir):
    return C.resolve_answers(V.corpus(spark, sf_dir), "customer_text", "first_answer",
                             "second_answer").select(*_CLASS_COLS)


_CASCADED = f"""cascaded AS (SELECT pair_id, CASE WHEN kw <> 'other' THEN kw ELSE intent END AS intent,
  CASE WHEN kw <> 'other' THEN NULL ELSE intent_confidence END AS intent_confidence,
  CASE WHEN kw <> 'other' THEN '{K.RATIONALE_KEYWORD}' ELSE intent_rationale END AS intent_rationale,
  CASE WHEN kw <> 'other' THEN '{K.SOURCE_KEYWORD}' ELSE '{K.SOURCE_FALLBACK}' END AS source,
  kw = 'other' AND reconsidered AS reconsidered
  FROM (SELECT *, {keyword_sql("customer_text")} AS kw FROM classified))"""


@query("d6_cascade_stored_answers", f"SELECT {', '.join(_CLASS_COLS)} FROM cascaded",
       (*CLASSIFIED_CTES, _CASCADED))
def d6(spark, sf_dir):
    return C.cascade_answers(V.corpus(spark, sf_dir), "customer_text", "first_answer",
                             "second_answer").select(*_CLASS_COLS)


@query("d6_cascade_report", "SELECT source, count(*) AS n_rows, count_if(intent <> 'other') AS n_placed "
                            "FROM cascaded GROUP BY source", (*CLASSIFIED_CTES, _CASCADED))
def d6_report(spark, sf_dir):
    return C.cascade_report(C.cascade_answers(V.corpus(spark, sf_dir), "customer_text", "first_answer",
                                              "second_answer"))


# --- models as callables -----------------------------------------------------------------------------

def _toy_answer(prompt: str) -> str:
    """A stand-in for a model: the label depends on the prompt's length."""
    label = K.TAXONOMY[len(prompt) % len(K.TAXONOMY)]
    return f'{{"intent": "{label}", "confidence": 0.8, "rationale": "by length"}}'


_TOY_LEN = f"length({classify_prompt_sql('text')})"


@query("d5_classify_with_model", f"""
SELECT tweet_id, seq, CASE WHEN {safety_sql("text")} THEN '{K.SAFETY}'
  WHEN label = 'other' THEN second ELSE label END AS intent, {safety_sql("text")} AS by_rule
FROM (SELECT *, {V.pick_sql(K.TAXONOMY, _TOY_LEN)} AS label,
  {V.pick_sql(K.TAXONOMY, "length(" + fill_sql(
      P.SECOND_LOOK_TEMPLATE, first_prompt=classify_prompt_sql("text"),
      first_answer=V.quoted('{"intent": "other", "confidence": 0.8, "rationale": "by length"}'),
      labels=V.quoted(", ".join(K.TAXONOMY))) + ")")} AS second
  FROM tweets)""", _TWEETS)
def d5_model(spark, sf_dir):
    df = V.tweets(spark, sf_dir).select("tweet_id", "seq", "text")
    out = C.classify(df, scoring.text_model(_toy_answer), "text")
    return out.select("tweet_id", "seq", "intent",
                      F.coalesce(F.col("source") == K.SOURCE_SAFETY, F.lit(False)).alias("by_rule"))


_LEDGER_KEYS = ("SELECT pair_id FROM pairs UNION SELECT pair_id FROM corpus WHERE vec_id % 37 <> 0")


@query("s5_j3_append_ledger", f"SELECT pair_id, CAST(1 AS BIGINT) AS n_stored FROM ({_LEDGER_KEYS}) UNION ALL "
       "SELECT NULL, 2 * count(*) FROM corpus WHERE vec_id % 37 = 0 HAVING count(*) > 0",
       (*_PAIRED, V.CORPUS_SQL))
def s5_ledger(spark, sf_dir):
    """Overlapping runs into a ledger, with one between them that never commits."""
    paired = _pairs(spark, sf_dir).select("pair_id")
    other = V.messages(spark, sf_dir).select("pair_id")
    store = Ledger(spark, scratch_path(spark, "ledger"), schemas.struct(pair_id=schemas._STR))
    store.append(paired)
    store._write(other)
    store.append(other)
    store.append(paired.unionByName(other))
    return store.rows().groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_stored"))


@query("c1_answer_ledger", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN "
       "CAST(length(text) AS VARCHAR) || ' letters' END AS answer, "
       "(SELECT count(DISTINCT text) FROM conversations WHERE role = 'user') AS n_asked FROM conversations")
def c1_ledger(spark, sf_dir):
    """User turns answered through an answer book, which is asked again for all turns."""
    rows = V.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("prompt"))
    book = AnswerBook(spark, scratch_path(spark, "answers"))
    load, user = scoring.text_model(lambda prompt: f"{len(prompt)} letters"), F.col("role") == "user"
    book.score(rows, "letters", load, user)
    again = book.score(rows, "letters", load, user)
    return again.select("conv_id", "turn", "answer", F.lit(book.answers().count()).alias("n_asked"))


@query("c1_score_batches", "SELECT doc_id, CASE WHEN lang = 'en' THEN length(text) END AS n_seen FROM documents")
def c1(spark, sf_dir):
    import pandas as pd

    def load():
        return lambda rows: pd.DataFrame({"n_seen": [len(t) for t in rows["text"]]})

    df = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return scoring.score_batches(df, load, ["text"], schemas.struct(n_seen=schemas._LONG),
                                 F.col("lang") == "en").select("doc_id", "n_seen")


@query("m6_c7_judge_summary_model", f"""
SELECT avg(score) AS mean_overall_score, count(score) AS n_scored,
  count_if(score IS NULL) AS n_unparseable
FROM (SELECT CASE WHEN n % 7 = 0 THEN NULL ELSE n % 5 + 1 END AS score FROM (
  SELECT length({fill_sql(P.JUDGE_TEMPLATE, message="customer_text", reply="reply")}) AS n
  FROM (SELECT g.customer_text, p.reply FROM g JOIN p ON g.pair_id = p.pair_id
        WHERE coalesce(p.reply, '') <> '')))""", (
    *_GOLD, "g AS (SELECT * FROM golden QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY seq DESC) = 1)",
    "p AS (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY "
    + ", ".join(f"{c} DESC" for c in V.PRED_ORDER) + ") = 1)"))
def m6_model(spark, sf_dir):
    from replyloom.operators.evaluate import judge_summary

    return judge_summary(judged_by_length(spark, sf_dir))


def judged_by_length(spark, sf_dir) -> DataFrame:
    """Drafted replies judged by a model that scores the length of its prompt."""
    def answer(prompt: str) -> str:
        n = len(prompt)
        return "cannot say" if n % 7 == 0 else f'{{"overall": {n % 5 + 1}, "rationale": "by length"}}'

    joined = join_gold_pred(V.golden(spark, sf_dir), V.predictions(spark, sf_dir), ("seq",), V.PRED_ORDER)
    return scoring.judge_replies(joined.select("pair_id", "customer_text", "reply"),
                                 scoring.text_model(answer))
