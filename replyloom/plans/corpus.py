"""From stored pairs to the searchable corpus."""

from __future__ import annotations

from pyspark.sql import SparkSession

from replyloom import schemas
from replyloom.operators.features import embed
from replyloom.operators.scoring import Loader
from replyloom.sources.io import read_jsonl, save_corpus


def build_corpus(spark: SparkSession, pairs_path: str, out_path: str, document_encoder: Loader, *,
                 model_name: str, mode: str = "errorifexists") -> None:
    """Encode the customer texts of stored pairs and save pairs, vectors and encoder name.

    Encode messages to triage with ``embed`` and the query side of the same encoder.
    """
    pairs = read_jsonl(spark, pairs_path, schemas.PAIRS)
    save_corpus(embed(pairs, document_encoder, "customer_text"), out_path, model_name, mode)
