"""From a message export to the stored pairs of one brand."""

from __future__ import annotations

from pyspark.sql import SparkSession

from replyloom.operators.pairs import brand_biased_sample, build_pairs
from replyloom.sources.io import read_messages_csv, write_jsonl

# The export has no line number; a repeated id is resolved by its remaining columns.
MESSAGE_ORDER = ("tweet_id", "created_at", "inbound", "author_id", "in_response_to_tweet_id",
                 "text")


def csv_to_pairs(spark: SparkSession, csv_path: str, brand: str, out_path: str, *,
                 sample: int | None = None, latin_only: bool = True, seed: int = 42,
                 order_by=MESSAGE_ORDER, mode: str = "errorifexists") -> None:
    """Read the CSV, optionally thin it out, pair, clean, filter and write JSON lines."""
    messages = read_messages_csv(spark, csv_path)
    messages = brand_biased_sample(messages, brand, sample, order_by, seed=seed)
    pairs = build_pairs(messages, brand, order_by, latin_only=latin_only)
    write_jsonl(pairs, out_path, mode, allow_empty=False)
