"""From raw messages to cleaned (customer message, brand reply) pairs of one brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from replyloom.constants import BRAND_LIST_SIZE, MAX_FOREIGN_RATIO, MIN_TEXT_CHARS
from replyloom.functions.text import clean_text, is_latin_script, long_enough
from replyloom.operators.keys import Order, _cols, compute_once, first_by_key, lookup_join

# Leading hex digits of the random pick that are counted to find where a sample is cut.
_CUT_DIGITS = 4


def brand_messages(df: DataFrame, brand: str) -> DataFrame:
    """Messages written by the brand itself; a null ``inbound`` does not count as one."""
    return df.where((F.col("author_id") == brand) & (F.col("inbound") == F.lit(False)))


def has_parent(df: DataFrame) -> DataFrame:
    """Messages that answer another message."""
    return df.where(F.col("in_response_to_tweet_id").isNotNull())


def parent_is_customer(inbound: Column | str) -> Column:
    """True when the (already chosen) parent row is a customer message."""
    c = F.col(inbound) if isinstance(inbound, str) else inbound
    return F.coalesce(c, F.lit(False))


def brand_volume(df: DataFrame, k: int = BRAND_LIST_SIZE) -> DataFrame:
    """The ``k`` brands with most messages of their own."""
    return (df.where(F.col("inbound") == F.lit(False))
            .groupBy(F.col("author_id").alias("brand_handle"))
            .agg(F.count(F.lit(1)).alias("tweet_count"))
            .orderBy(F.col("tweet_count").desc(), F.col("brand_handle"))
            .limit(k))


def _replies(messages: DataFrame, brand: str) -> DataFrame:
    return brand_messages(messages, brand).select(
        F.col("tweet_id").alias("brand_tweet_id"),
        F.col("in_response_to_tweet_id").alias("parent_id"),
        F.col("text").alias("reply_text"),
    )


def _parents(messages: DataFrame, replies: DataFrame, order_by: Order) -> DataFrame:
    """First row of every message id that the replies refer to, text not yet cleaned.

    Other messages leave before the choice of the first row. The ids are the narrow side, so they
    are hashed in each task and the messages pass by them unsorted; only those that stay are sorted.
    """
    carried = {"tweet_id": "customer_tweet_id", "inbound": "parent_inbound", "text": "parent_text",
               "created_at": "created_at"}
    # An order column that is carried anyway is not copied.
    order = [carried[c] if isinstance(c, str) and c in carried else f"__o{i}"
             for i, c in enumerate(order_by)]
    copies = {name: c for name, c in zip(order, _cols(order_by)) if name.startswith("__o")}
    candidates = messages.select(
        *[F.col(c).alias(name) for c, name in carried.items()],
        *[c.alias(name) for name, c in copies.items()],
    )
    wanted = replies.where(F.col("parent_id").isNotNull()).select("parent_id").distinct()
    candidates = candidates.join(wanted.hint("shuffle_hash"),
                                 candidates.customer_tweet_id == wanted.parent_id, "left_semi")
    return first_by_key(candidates, ["customer_tweet_id"], order).drop(*copies)


def join_parent(messages: DataFrame, brand: str, order_by: Order, how: str = "inner", *,
                dedupe: bool = False) -> DataFrame:
    """Every reply of ``brand`` beside the message it answers (texts cleaned)."""
    replies = _replies(messages, brand)
    parents = _parents(messages, replies, order_by)
    if dedupe:
        replies = _replies(first_by_key(messages, ["tweet_id"], order_by), brand)
    if how == "inner":
        # The first row decides, so this filter comes after the choice of that row.
        replies = replies.where(F.col("parent_id").isNotNull())
        parents = parents.where(parent_is_customer("parent_inbound"))
    replies = compute_once(replies, "brand_reply", clean_text("reply_text", is_reply=True))
    parents = compute_once(parents, "customer_text", clean_text("parent_text"))
    return lookup_join(replies.drop("reply_text"), parents.drop("parent_text"), "parent_id",
                       "customer_tweet_id", how)


def pair_projection(joined: DataFrame) -> DataFrame:
    """The pair columns, with ``pair_id`` = customer id and brand id."""
    return joined.select(
        F.concat_ws("_", "customer_tweet_id", "brand_tweet_id").alias("pair_id"),
        "customer_tweet_id", "brand_tweet_id", "customer_text", "brand_reply", "created_at",
    )


def build_pairs(messages: DataFrame, brand: str, order_by: Order, *, latin_only: bool = True,
                max_foreign_ratio: float = MAX_FOREIGN_RATIO, min_chars: int = MIN_TEXT_CHARS,
                dedupe: bool = False) -> DataFrame:
    """Cleaned pairs of ``brand``.

    ``order_by`` must be a total order of the messages; it decides which row of a repeated id
    is used. ``dedupe`` also keeps only the first row of a repeated reply id.
    """
    joined = join_parent(messages, brand, order_by, dedupe=dedupe)
    kept = joined.where(long_enough("customer_text", min_chars) & long_enough("brand_reply", min_chars))
    if latin_only:
        kept = kept.where(is_latin_script("customer_text", max_foreign_ratio))
    return pair_projection(kept)


def drop_report(messages: DataFrame, brand: str, order_by: Order, *, latin_only: bool = True,
                max_foreign_ratio: float = MAX_FOREIGN_RATIO, min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """How many replies were kept, and how many were dropped by the first cause that applies."""
    joined = join_parent(messages, brand, order_by, "left")
    outcome = (
        F.when(F.col("parent_id").isNull(), "no_parent_id")
        .when(F.col("customer_tweet_id").isNull(), "parent_missing")
        .when(~parent_is_customer("parent_inbound"), "parent_not_customer")
        .when(~(long_enough("customer_text", min_chars) & long_enough("brand_reply", min_chars)),
              "too_short")
    )
    if latin_only:
        outcome = outcome.when(~is_latin_script("customer_text", max_foreign_ratio), "non_latin")
    return (joined.select(outcome.otherwise("kept").alias("outcome"))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("n_replies")))


def seeded_hash(seed: int, *cols: Column | str) -> Column:
    """Pseudo-random sort key that is the same on every engine and every run."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in _cols(cols)]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def _smallest_picks(rows: DataFrame, n: int, order: Order) -> DataFrame:
    """The ``n`` first rows by ``order``, whose first column is the hash ``__pick``.

    The hash's first digits are counted (at most 16^4 rows reach the driver). Every row below the
    group in which the cut falls is taken as it is; only that group, about one row in 65,536, is
    sorted.
    """
    group = F.substring("__pick", 1, _CUT_DIGITS)
    left = n
    for row in sorted(rows.groupBy(group.alias("g")).count().collect(), key=lambda r: r["g"]):
        if row["count"] >= left:
            cut = row["g"]
            return rows.where(group < cut).unionByName(
                rows.where(group == cut).orderBy(*_cols(order)).limit(left))
        left -= row["count"]
    return rows


def brand_biased_sample(messages: DataFrame, brand: str, n: int | None, order_by: Order, *,
                        seed: int = 42, keep_parents: bool = False) -> DataFrame:
    """All rows written by ``brand`` plus ``n`` random other rows, then one row per id.

    The random rows may lack the parents of the brand's replies; ``keep_parents`` adds them.
    A zero or missing ``n`` returns the input unchanged.
    """
    if not n:
        return messages
    is_brand = F.coalesce(F.col("author_id") == brand, F.lit(False))
    others = messages.where(~is_brand).withColumn(
        "__pick", seeded_hash(seed, "tweet_id", *_cols(order_by)))
    picked = _smallest_picks(others, n, ["__pick", *_cols(order_by)])
    # Brand rows come first, so they win over a random row with the same id.
    chosen = messages.where(is_brand).withColumn("__tier", F.lit(0)).unionByName(
        picked.drop("__pick").withColumn("__tier", F.lit(1)))
    if keep_parents:
        wanted = has_parent(brand_messages(messages, brand)).select(
            F.col("in_response_to_tweet_id").alias("parent_id")).distinct()
        parents = messages.where(~is_brand).join(
            wanted, F.col("tweet_id") == F.col("parent_id"), "left_semi")
        chosen = chosen.unionByName(parents.withColumn("__tier", F.lit(2)))
    picks = F.when(F.col("__tier") == 1, seeded_hash(seed, "tweet_id", *_cols(order_by)))
    return first_by_key(chosen, ["tweet_id"], ["__tier", picks, *_cols(order_by)]).drop("__tier")
