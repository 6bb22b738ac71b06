"""Samples for hand labelling and the ordered train/test split."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from replyloom import constants as K
from replyloom.operators.keys import Order, _cols, global_rank, lookup_join, top_per_key
from replyloom.operators.pairs import seeded_hash
from replyloom.session import materialise


def cluster_count(n: int, outlier_fraction: float = K.OUTLIER_SHARE) -> int:
    """Clusters used for a sample of ``n``: one per five clustered rows, between 2 and 20."""
    clustered = n - int(n * outlier_fraction)
    return min(20, max(2, clustered // 5))


def centroids(df: DataFrame, cluster: str = "cluster", vector: str = "embedding") -> DataFrame:
    """Mean vector per cluster, combined map-side: one partial vector per task and cluster."""
    return df.groupBy(F.col(cluster).alias("centroid_of")).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias("centroid"))


def centroid_distance(df: DataFrame, cluster: str = "cluster", vector: str = "embedding",
                      name: str = "distance") -> DataFrame:
    """Add the Euclidean distance of each row to the mean of its own cluster."""
    joined = lookup_join(df, centroids(df, cluster, vector), cluster, "centroid_of")
    squares = F.zip_with(vector, "centroid", lambda x, m: (x - m) * (x - m))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)
    return joined.withColumn(name, F.sqrt(total)).drop("centroid", "centroid_of")


def cluster_stratified_sample(
    df: DataFrame, n: int = K.SAMPLE_SIZE, outlier_fraction: float = K.OUTLIER_SHARE, *,
    row_id: str = "pair_id", order_by: Order = ("pair_id",), cluster: str = "cluster",
    vector: str = "embedding", seed: int = 42, n_clusters: int | None = None,
) -> DataFrame:
    """Equal random shares per cluster plus the rows farthest from their own centroid.

    A cluster smaller than its share gives what it has; nothing tops the sample up. ``row_id``
    must be unique. The sample itself is small, since people label it.
    """
    n_outliers = int(n * outlier_fraction)
    n_clustered = n - n_outliers
    k = n_clusters or cluster_count(n, outlier_fraction)
    share = max(1, n_clustered // k)
    measured = centroid_distance(df, cluster, vector)
    picks = top_per_key(df, [cluster], [seeded_hash(seed, row_id), F.col(row_id)], share)
    picks = materialise(picks.select(row_id))
    rest = measured.join(picks, row_id, "left_anti")
    outliers = rest.orderBy(F.round("distance", 6).desc(), *_cols(order_by)).limit(n_outliers)
    chosen = df.join(picks, row_id, "left_semi").unionByName(outliers.select(*df.columns))
    return chosen.orderBy(*_cols(order_by)).limit(n)


def label_template(df: DataFrame) -> DataFrame:
    """Chosen pairs with empty label columns for a person to fill in."""
    return df.select(
        "pair_id", "customer_text", "brand_reply",
        F.lit("").alias("gold_intent"),
        F.lit(None).cast("boolean").alias("gold_escalate"),
        F.lit("").alias("gold_escalate_reason"),
        F.lit("").alias("notes"),
    )


def holdout_split(df: DataFrame, order_by: Order,
                  train_share: float = K.HOLDOUT_TRAIN_SHARE) -> DataFrame:
    """Add ``is_train``: true for the first ``int(train_share * n)`` rows by ``order_by``.

    The cut is a rank, so all that is read twice is the written, numbered copy.
    """
    ranked = global_rank(df, order_by, "__rank")
    cut = int(ranked.count() * train_share)
    return ranked.withColumn("is_train", F.col("__rank") <= cut).drop("__rank")


def can_train(split: DataFrame, label: str = "gold_intent",
              min_rows: int = K.MIN_TRAIN_ROWS) -> bool:
    """True when the train part has ``min_rows`` rows and more than one label."""
    row = split.where("is_train").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min(label) != F.max(label)).alias("mixed")).first()
    return row["n"] >= min_rows and bool(row["mixed"])
