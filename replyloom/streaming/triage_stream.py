"""Triage as a restartable Structured Streaming job."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from replyloom.plans.triage import Classifier, triage

#: The keyed state lives on the executors' disks and is checkpointed as changes, so it may outgrow
#: their memory and a commit costs what the batch has changed.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stored_decisions(spark: SparkSession, out: str) -> DataFrame:
    """All decisions of a stream with the batch that made them; empty before the first one."""
    try:
        return spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "pair_id STRING, batch_id BIGINT")


def once_per_key(messages: DataFrame, key: str = "pair_id") -> DataFrame:
    """The stream with the first message of every key; messages without a key always pass.

    Keys that were seen are keyed state of the query: a batch reads the state of its own keys and
    nothing that earlier batches wrote. Keyless messages take no part in the state.
    """
    keyless = F.col(key).isNull() | (F.col(key) == "")
    return messages.where(~keyless).dropDuplicates([key]).unionByName(messages.where(keyless))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def triage_stream(messages: DataFrame, corpus: DataFrame, classifier: Classifier, out: str,
                  checkpoint: str, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Start a query that decides each incoming message once.

    Every micro-batch owns one ``batch_id=`` folder and overwrites it, so a batch that is run
    again after a failure leaves no duplicates, not even of rows without a key. The keys decided
    are state of the ``checkpoint``; a new checkpoint therefore needs a new ``out``, else its first
    batches would overwrite others. By default the query stops when the input is used up.
    """
    spark = messages.sparkSession
    if not _exists(spark, f"{checkpoint}/offsets") and not stored_decisions(spark, out).isEmpty():
        raise ValueError(f"{out} holds decisions of another checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        triage(batch, corpus, classifier, **options).write.mode("overwrite").parquet(
            f"{out}/batch_id={batch_id}")

    before = {name: spark.conf.get(name, None) for name in _STATE}
    try:
        for name, value in _STATE.items():
            spark.conf.set(name, value)
        return (once_per_key(messages).writeStream.foreachBatch(write)
                .option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True}))
                .start())
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
