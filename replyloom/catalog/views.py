"""Message, pair, label and prediction tables derived from the given Parquet tables.

Each view exists twice: as a DataFrame here and as SQL text (``*_SQL``) for the oracle. All read
their whole source tables; ``%`` only chooses wording and defects, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from replyloom.constants import TAXONOMY

BRAND = "brand_0"          # writes more than a third of all replies

PHRASES = (
    "I forgot my password and the login page loops",
    "please refund the double charge on my card",
    "the driver made me feel unsafe so I called the police",
    "the app has a bug and is not working",
    "where is my package, tracking shows nothing",
    "everything is down again",
    "this is unacceptable, get me a manager",
    "thank you, great job",
    "what are the opening hours",
    "Call 911, there was an ACCIDENT",
    "I can't sign in since monday",
    "hello there",
    "my order was cancelled and I want my money back",
    "the download is stuck",
    "how do I change my name",
    "an ambulance came, it was an emergency",
)

FIRST_ANSWERS = (
    '{"intent": "billing_refund", "confidence": 0.91, "rationale": "money"}',
    '```json\n{"intent": "order_delivery", "confidence": 0.745, "rationale": "parcel"}\n```',
    "I believe this is a question about a bill, but I cannot be sure without seeing the account first.",
    '{"intent": "weather", "confidence": 0.4, "rationale": "rain"}',
    '{"intent": "other", "confidence": 0.2, "rationale": "unsure"}',
    '{"confidence": 0.8, "rationale": "no label"}',
    "[1, 2]",
    '{"intent": "general_inquiry", "confidence": "0.9", "rationale": "quoted"}',
    '{"intent": "feedback_praise", "confidence": 0.75, "rationale": "thanks"}',
    '```\n{"intent": "safety_incident", "confidence": 1.0, "rationale": "hurt"}```',
    '```JSON {"intent": "product_defect", "confidence": 1, "rationale": "broken"} ```',
)

SECOND_ANSWERS = (
    '{"intent": "general_inquiry", "confidence": 0.8, "rationale": "asks"}',
    '{"intent": "other", "confidence": 0.1, "rationale": "still unsure"}',
    '{"intent": "gardening", "confidence": 0.9, "rationale": "plants"}',
    "no idea",
)

JUDGE_ANSWERS = (
    '{"relevance": 5, "correctness": 4, "tone": 5, "completeness": 3, "overall": 4, "rationale": "good"}',
    '```json\n{"relevance": 2, "correctness": 2, "tone": 3, "completeness": 1, "overall": 2, "rationale": "vague"}\n```',
    "a fine reply",
    '{"relevance": 1, "rationale": "partial"}',
)

_NBSP = "\u00a0"


# Tables whose rows take much work each (long texts).
_HEAVY = ("documents", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table. One whose rows take much work is dealt to all cores if Spark, which splits
    large files by itself, reads it in fewer parts than there are cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if (heavy or name in _HEAVY) and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def pick(values, index: Column) -> Column:
    """values[index % len(values)]"""
    return F.get(F.array(*[F.lit(v) for v in values]),
                 F.pmod(index, F.lit(len(values))).cast("int"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick_sql(values, index: str) -> str:
    items = ", ".join(quoted(v) for v in values)
    return f"([{items}])[(({index}) % {len(values)}) + 1]"


# --- messages ---------------------------------------------------------------------------

def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support messages from ``conversations``, with repeated ids and broken parents."""
    user = F.col("role") == "user"
    copies = F.sequence(F.lit(0), F.when(F.col("id") % 19 == 0, 1).otherwise(0))
    base = (table(spark, sf_dir, "conversations")
            .withColumn("id", F.col("conv_id") * 100 + F.col("turn") + 1)
            .withColumn("copy", F.explode(copies)))
    i = F.col("id")

    def some(cond: Column, value: Column | str) -> Column:
        return F.when(cond, F.lit(value) if isinstance(value, str) else value).otherwise(F.lit(""))

    text = F.concat(
        some(i % 3 == 0, "@helper_é "), pick(PHRASES, i), F.lit(" "), F.col("text"),
        some(i % 5 == 0, " https://t.co/a?b=1&c=é"), some(i % 4 == 0, f"{_NBSP}\t done {_NBSP}"),
        some(user & (i % 7 == 3), F.repeat(F.lit("説明 "), F.length("text"))),
        F.when(~user & (i % 2 == 0), " ^AB").when(~user, " ^ABCD").otherwise(F.lit("")),
    )
    return base.select(
        i.alias("tweet_id"),
        F.when(user, F.concat(F.lit("cust_"), "conv_id")).otherwise(F.concat(
            F.lit("brand_"), F.when(F.col("conv_id") % 3 == 0, 0).otherwise(F.col("conv_id") % 7))
        ).alias("author_id"),
        F.when(i % 29 == 0, F.lit(None)).otherwise(user == (F.col("copy") == 0)).alias("inbound"),
        F.concat(F.lit("2017-10-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"),
                 F.lit(" "), F.col("copy")).alias("created_at"),
        F.when(i % 31 == 0, F.lit(None)).when(i % 23 == 0, "@x ok").otherwise(text).alias("text"),
        F.lit(None).cast("string").alias("response_tweet_id"),
        F.when((F.col("turn") == 0) | (i % 11 == 0), F.lit(None)).when(i % 13 == 0, i + 50)
        .when(i % 17 == 0, i).otherwise(i - 1).alias("in_response_to_tweet_id"),
        (i * 10 + F.when(i % 38 == 0, 1 - F.col("copy")).otherwise(F.col("copy"))).alias("seq"),
    )


TWEETS_SQL = f"""
tweets AS (
  SELECT id AS tweet_id,
    CASE WHEN u THEN 'cust_' || conv_id
         ELSE 'brand_' || CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id % 7 END END AS author_id,
    CASE WHEN id % 29 = 0 THEN NULL ELSE u = (copy = 0) END AS inbound,
    '2017-10-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') || ' ' || copy AS created_at,
    CASE WHEN id % 31 = 0 THEN NULL WHEN id % 23 = 0 THEN '@x ok' ELSE
      (CASE WHEN id % 3 = 0 THEN '@helper_é ' ELSE '' END)
      || {pick_sql(PHRASES, "id")} || ' ' || text
      || (CASE WHEN id % 5 = 0 THEN ' https://t.co/a?b=1&c=é' ELSE '' END)
      || (CASE WHEN id % 4 = 0 THEN chr(160) || chr(9) || ' done ' || chr(160) ELSE '' END)
      || (CASE WHEN u AND id % 7 = 3 THEN repeat('説明 ', length(text)) ELSE '' END)
      || (CASE WHEN NOT u AND id % 2 = 0 THEN ' ^AB' WHEN NOT u THEN ' ^ABCD' ELSE '' END)
    END AS text,
    CAST(NULL AS VARCHAR) AS response_tweet_id,
    CASE WHEN turn = 0 OR id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN id + 50
         WHEN id % 17 = 0 THEN id ELSE id - 1 END AS in_response_to_tweet_id,
    id * 10 + CASE WHEN id % 38 = 0 THEN 1 - copy ELSE copy END AS seq
  FROM (SELECT *, role = 'user' AS u,
          unnest(CASE WHEN id % 19 = 0 THEN [0, 1] ELSE [0] END) AS copy
        FROM (SELECT *, conv_id * 100 + turn + 1 AS id FROM conversations))
)"""


def tweets_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support messages from ``orders`` (customers) and ``lineitem`` (replies)."""
    key = F.col("o_orderkey")
    customers = table(spark, sf_dir, "orders", heavy=True).select(
        (key * 100).alias("tweet_id"), F.concat(F.lit("cust_"), "o_custkey").alias("author_id"),
        F.lit(True).alias("inbound"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        F.concat_ws(" ", pick(PHRASES, key), "o_orderpriority", "o_orderstatus").alias("text"),
        F.lit(None).cast("bigint").alias("in_response_to_tweet_id"))
    part, reply_id = F.col("l_partkey"), F.col("l_orderkey") * 100 + F.col("l_linenumber")
    replies = table(spark, sf_dir, "lineitem", heavy=True).select(
        reply_id.alias("tweet_id"),
        F.concat(F.lit("brand_"), F.when(F.col("l_suppkey") % 3 == 0, 0)
                 .otherwise(F.col("l_suppkey") % 7)).alias("author_id"),
        F.lit(False).alias("inbound"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("created_at"),
        F.concat(F.lit("@cust_1 "), pick(PHRASES, part), F.lit(" part "), part, F.lit(" ^"),
                 "l_returnflag", "l_linestatus").alias("text"),
        F.when(part % 11 == 0, F.lit(None)).when(part % 13 == 0, -F.col("l_orderkey") - 1)
        .when(part % 17 == 0, reply_id).otherwise(F.col("l_orderkey") * 100)
        .alias("in_response_to_tweet_id"))
    return customers.unionByName(replies)


TWEETS_LARGE_SQL = f"""
tweets_large AS (
  SELECT o_orderkey * 100 AS tweet_id, 'cust_' || o_custkey AS author_id, TRUE AS inbound,
    strftime(o_orderdate, '%Y-%m-%d') AS created_at,
    {pick_sql(PHRASES, "o_orderkey")} || ' ' || o_orderpriority || ' ' || o_orderstatus AS text,
    CAST(NULL AS BIGINT) AS in_response_to_tweet_id
  FROM orders
  UNION ALL
  SELECT l_orderkey * 100 + l_linenumber,
    'brand_' || CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 7 END, FALSE,
    strftime(l_shipdate, '%Y-%m-%d'),
    '@cust_1 ' || {pick_sql(PHRASES, "l_partkey")} || ' part ' || l_partkey || ' ^'
      || l_returnflag || l_linestatus,
    CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN -l_orderkey - 1
         WHEN l_partkey % 17 = 0 THEN l_orderkey * 100 + l_linenumber ELSE l_orderkey * 100 END
  FROM lineitem
)"""

TWEETS_ORDER = ("seq",)
TWEETS_LARGE_ORDER = ("tweet_id", "created_at", "text")


# --- corpus and messages to triage --------------------------------------------------------

def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved cases with vectors, and the stored model answers of their messages."""
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("p"), i).alias("pair_id"), i.alias("vec_id"),
        F.concat_ws(" ", pick(PHRASES, i), pick(PHRASES, i * 7 + 3)).alias("customer_text"),
        F.concat(F.lit("reply "), i, F.lit(" "), pick(PHRASES, i * 5 + 1)).alias("brand_reply"),
        "embedding", F.col("label").alias("cluster"),
        pick(FIRST_ANSWERS, i).alias("first_answer"),
        pick(SECOND_ANSWERS, F.floor(i / 11)).alias("second_answer"),
    )


CORPUS_SQL = f"""
corpus AS (
  SELECT 'p' || vec_id AS pair_id, vec_id,
    {pick_sql(PHRASES, "vec_id")} || ' ' || {pick_sql(PHRASES, "vec_id * 7 + 3")} AS customer_text,
    'reply ' || vec_id || ' ' || {pick_sql(PHRASES, "vec_id * 5 + 1")} AS brand_reply,
    CAST(embedding AS DOUBLE[]) AS embedding, label AS cluster,
    {pick_sql(FIRST_ANSWERS, "vec_id")} AS first_answer,
    {pick_sql(SECOND_ANSWERS, "vec_id // 11")} AS second_answer
  FROM embeddings
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus messages as new input; an empty key every 37th row."""
    return corpus(spark, sf_dir).select(
        F.when(F.col("vec_id") % 37 == 0, F.lit(None)).otherwise(F.col("pair_id")).alias("pair_id"),
        "vec_id", "customer_text", "embedding", "first_answer", "second_answer")


def queries_of(df: DataFrame) -> DataFrame:
    """Every corpus row as a query that must not find itself."""
    return df.select(F.col("pair_id").alias("query_id"), F.col("pair_id").alias("exclude_id"),
                     F.col("customer_text").alias("message"), "embedding")


# --- labels and predictions -----------------------------------------------------------------

def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from ``orders``; orders in progress were labelled twice, the later label counts.
    Orders of low priority have a key that no prediction has."""
    key = F.col("o_orderkey")
    copies = F.sequence(F.lit(0), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0))
    return (table(spark, sf_dir, "orders")
            .withColumn("copy", F.explode(copies)).select(
        F.concat(F.when(F.col("o_orderpriority") == "5-LOW", "u").otherwise("p"), key).alias("pair_id"),
        F.concat_ws(" ", pick(PHRASES, key), "o_orderpriority").alias("customer_text"),
        pick(TAXONOMY, key + F.col("copy")).alias("gold_intent"),
        F.when(F.col("o_custkey") % 7 == 0, F.lit(None))
        .otherwise(F.col("o_orderstatus") == "F").alias("gold_escalate"),
        (key * 2 + F.col("copy")).alias("seq")))


GOLDEN_SQL = f"""
golden AS (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'u' ELSE 'p' END || o_orderkey AS pair_id,
    {pick_sql(PHRASES, "o_orderkey")} || ' ' || o_orderpriority AS customer_text,
    {pick_sql(TAXONOMY, "o_orderkey + copy")} AS gold_intent,
    CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS gold_escalate,
    o_orderkey * 2 + copy AS seq
  FROM (SELECT *, unnest(CASE WHEN o_orderstatus = 'P' THEN [0, 1] ELSE [0] END) AS copy
        FROM orders)
)"""

PRED_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored decisions from ``lineitem``: several per key, the last counts."""
    key = F.col("l_orderkey")

    def pid(c: Column) -> Column:
        return F.concat(F.lit("p"), c)

    return table(spark, sf_dir, "lineitem").select(
        pid(key).alias("pair_id"),
        F.when(F.col("l_partkey") % 3 == 0, pick(TAXONOMY, key))
        .otherwise(pick(TAXONOMY, F.col("l_suppkey"))).alias("intent"),
        F.when(F.col("l_tax") == 0.0, F.lit(None)).otherwise(F.col("l_returnflag") == "R")
        .alias("escalate"),
        F.when(F.col("l_returnflag") == "A", F.lit(None)).when(F.col("l_tax") == 0.0, "")
        .otherwise(F.concat(F.lit("reply "), "l_partkey")).alias("reply"),
        F.when(F.col("l_discount") == 0.0, F.lit(None)).when(
            F.col("l_discount") == 0.05, F.array(pid(F.col("l_suppkey")), pid(key)))
        .otherwise(F.array(pid(key + 1))).alias("grounded_on"),
        F.round(F.col("l_discount") * 10, 2).alias("top_similarity"),
        *PRED_ORDER,
    )


PREDICTIONS_SQL = f"""
predictions AS (
  SELECT 'p' || l_orderkey AS pair_id,
    CASE WHEN l_partkey % 3 = 0 THEN {pick_sql(TAXONOMY, "l_orderkey")}
         ELSE {pick_sql(TAXONOMY, "l_suppkey")} END AS intent,
    CASE WHEN l_tax = 0.0 THEN NULL ELSE l_returnflag = 'R' END AS escalate,
    CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_tax = 0.0 THEN ''
         ELSE 'reply ' || l_partkey END AS reply,
    CASE WHEN l_discount = 0.0 THEN NULL
         WHEN l_discount = 0.05 THEN ['p' || l_suppkey, 'p' || l_orderkey]
         ELSE ['p' || (l_orderkey + 1)] END AS grounded_on,
    round(l_discount * 10, 2) AS top_similarity, {", ".join(PRED_ORDER)}
  FROM lineitem
)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge and human scores from ``lineitem``; some rows lack the human score."""
    judge = F.col("l_quantity").cast("int") % 5 + 1
    human = F.greatest(F.lit(1), F.least(F.lit(5), judge + (F.col("l_partkey") % 3).cast("int") - 1))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("pair_id"),
        judge.alias("judge_overall"),
        F.when(F.col("l_tax") == 0.0, F.lit(None)).otherwise(human).alias("human_overall"))


REVIEWS_SQL = """
reviews AS (
  SELECT l_orderkey || '_' || l_linenumber AS pair_id,
    CAST(l_quantity AS INT) % 5 + 1 AS judge_overall,
    CASE WHEN l_tax = 0.0 THEN NULL
         ELSE greatest(1, least(5, CAST(l_quantity AS INT) % 5 + 1 + CAST(l_partkey % 3 AS INT) - 1))
    END AS human_overall
  FROM lineitem
)"""
