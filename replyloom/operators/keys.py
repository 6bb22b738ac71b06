"""Row choice by key, joins that survive hot keys, and numbering without one big task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from replyloom.session import materialise

Order = Sequence[Column | str]


def _cols(order: Order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters use.

    Spark moves a filter below a plain projection and repeats the column's expression in it, once
    per mention. It does not move filters below a generator, so the value is computed once.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1,
                rank_col: str | None = None) -> DataFrame:
    """The ``k`` first rows per key. Spark limits each group map-side before the shuffle,
    so a key with a third of all rows sends at most ``k`` rows per input task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank_col or "__rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def first_by_key(df: DataFrame, keys: Sequence[str], order_by: Order) -> DataFrame:
    """One row per key: the first by ``order_by`` (give a total order)."""
    return top_per_key(df, keys, [c.asc_nulls_first() for c in _cols(order_by)])


def last_by_key(df: DataFrame, keys: Sequence[str], order_by: Order) -> DataFrame:
    """One row per key: the last by ``order_by`` (give a total order)."""
    return top_per_key(df, keys, [c.desc_nulls_last() for c in _cols(order_by)])


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                how: str = "inner") -> DataFrame:
    """Join many ``left`` rows to the at most one ``right`` row of their key.

    The key's hash is added as a second join key. It changes no result, but it keeps Spark from
    reusing the partitioning that made ``right`` unique, so both inputs of the join are plain
    shuffles: only then can AQE split a hot key's partition and copy its one right row, or switch
    to a broadcast when the measured side is small. Rows of a left join that have no key meet
    nothing; they travel under a hash of their content, or all would be sorted by one task.
    """
    hashed = F.xxhash64(left_key)
    if how == "left":
        content = [left[f"`{f.name}`"] for f in left.schema.fields
                   if "map<" not in f.dataType.simpleString()]
        hashed = F.when(F.col(left_key).isNull(), F.xxhash64(*content)).otherwise(hashed)
    l = left.withColumn("__lh", hashed)
    r = right.withColumn("__rh", F.xxhash64(right_key))
    joined = l.join(r, (l[left_key] == r[right_key]) & (l["__lh"] == r["__rh"]), how)
    return joined.drop("__lh", "__rh")


def join_gold_pred(golden: DataFrame, predictions: DataFrame, order_by_gold: Order,
                   order_by_pred: Order, key: str = "pair_id") -> DataFrame:
    """Labels and predictions that share a key; the last row of a repeated key counts. A column
    that both sides have is taken from the labels.

    Both sides are unique after :func:`last_by_key`, whose partitioning the join reuses.
    """
    g = last_by_key(golden, [key], order_by_gold)
    p = last_by_key(predictions, [key], order_by_pred)
    shared = [c for c in p.columns if c in g.columns and c != key]
    return g.join(p.drop(*shared), key, "inner")


def require_overlap(joined: DataFrame) -> DataFrame:
    """Raise when labels and predictions share no key (reads one row at most)."""
    if joined.isEmpty():
        raise ValueError("labels and predictions share no pair_id")
    return joined


def unprocessed(df: DataFrame, done: DataFrame, key: str = "pair_id") -> DataFrame:
    """Rows of ``df`` whose key is not in ``done``. Rows without a key always pass.

    ``df`` is read once. Keyless rows travel under a hash of their content, so that many of them
    do not pile up in the partition of the null key.
    """
    keyless = F.col(key).isNull() | (F.col(key) == "")
    left = df.withColumn("__keyless", keyless).withColumn(
        "__key", F.when(keyless, F.xxhash64(*df.columns).cast("string")).otherwise(F.col(key)))
    right = done.where(~keyless).select(F.col(key).alias("__done"))
    known = (left["__key"] == right["__done"]) & ~left["__keyless"]
    return left.join(right, known, "left_anti").drop("__keyless", "__key")


def grounding_leak(grounded_on: Column | str, pair_id: Column | str) -> Column:
    """True when a row was grounded on its own pair."""
    grounded = F.col(grounded_on) if isinstance(grounded_on, str) else grounded_on
    own = F.col(pair_id) if isinstance(pair_id, str) else pair_id
    return F.coalesce(
        F.array_contains(F.coalesce(grounded, F.array().cast("array<string>")), own), F.lit(False))


def global_rank(df: DataFrame, order_by: Order, rank_col: str = "rank") -> DataFrame:
    """Number all rows 1..n by ``order_by`` without sorting them in one task.

    Range-partition and sort, write that copy once, then add each partition's offset. The written
    copy fixes the partition numbers, which sampling would otherwise choose anew on every read.
    The offsets table has one row per partition.
    """
    order = [c.asc_nulls_first() for c in _cols(order_by)]
    pos = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__pos", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__pos", 33))
    sizes = pos.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"),
                                      F.min("__pos").alias("__start"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", "__start", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (pos.join(F.broadcast(offsets), "__part")
            .withColumn(rank_col, F.col("__offset") + F.col("__pos") - F.col("__start") + 1)
            .drop("__part", "__pos", "__start", "__offset"))
