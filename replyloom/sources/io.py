"""Readers and writers: message CSV, JSON lines, corpus, append-once store, report."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from replyloom import schemas
from replyloom.constants import DEFAULT_ENCODER
from replyloom.operators.keys import unprocessed

_CSV = {"header": True, "quote": '"', "escape": '"'}


def read_messages_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Message CSV by header name, with declared types.

    Quoted texts may hold line breaks, so ``multi_line`` is on; Spark then reads one file per
    task, and a large export should come as many files. Turn it off for files without embedded
    line breaks to split large files. The parent id may be written as ``12`` or ``12.0``.
    """
    names = spark.read.options(**_CSV).csv(path).columns       # first line only
    wanted = {f.name: f.dataType for f in schemas.MESSAGES.fields}
    missing = [n for n in wanted if n not in names]
    if missing:
        raise ValueError(f"message CSV lacks the columns {missing}")
    parent = "in_response_to_tweet_id"
    schema = T.StructType([
        T.StructField(n, T.StringType() if n == parent else wanted.get(n, T.StringType()))
        for n in names])
    raw = spark.read.options(**_CSV, multiLine=multi_line).schema(schema).csv(path)
    return raw.select(*[
        F.expr(f"try_cast(try_cast({n} AS DECIMAL(38, 6)) AS BIGINT)").alias(n)
        if n == parent else F.col(n) for n in schemas.MESSAGES.names])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType,
               drop_malformed: bool = False) -> DataFrame:
    """JSON lines with a declared schema; absent fields are null. A line that is no JSON object
    stops the read, or is left out with ``drop_malformed``."""
    mode = "DROPMALFORMED" if drop_malformed else "FAILFAST"
    return spark.read.schema(schema).option("mode", mode).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists",
                allow_empty: bool = True) -> None:
    """JSON lines, nulls written out. ``allow_empty=False`` raises when nothing was written; the
    rows are counted while they are written, so the plan runs once."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option(
        "ignoreNullFields", False).json(path)
    if not allow_empty and not seen.get["n"]:
        raise ValueError("no rows to write; check the brand name or enlarge the sample")


def save_corpus(df: DataFrame, path: str, model_name: str,
                mode: str = "errorifexists") -> None:
    """Pairs and their vectors as Parquet, with the encoder's name."""
    df.withColumn("model_name", F.lit(model_name)).write.mode(mode).parquet(path)


def load_corpus(spark: SparkSession, path: str, default_model: str = DEFAULT_ENCODER) -> DataFrame:
    """A saved corpus; a file written without a model name gets the default one."""
    df = spark.read.parquet(path)
    name = F.col("model_name") if "model_name" in df.columns else F.lit(None)
    return df.withColumn("model_name", F.coalesce(name, F.lit(default_model)))


def read_store(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """What an append store holds so far; empty when nothing was written yet.
    Lines that cannot be read (a crash can leave one) are skipped."""
    reader = spark.read.schema(schema)
    if fmt == "json":
        reader = reader.option("mode", "DROPMALFORMED")
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_new(df: DataFrame, path: str, key: str = "pair_id", fmt: str = "json") -> None:
    """Append the rows whose key is not stored yet; rows without a key are always appended."""
    spark = df.sparkSession
    stored = read_store(spark, path, T.StructType([df.schema[key]]), fmt)
    writer = unprocessed(df, stored, key).write.mode("append")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    writer.format(fmt).save(path)


def report_json(metrics: DataFrame) -> DataFrame:
    """Long-form metric rows (a few dozen) as one nested JSON document."""
    per_system = metrics.groupBy("section", "system").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m"))
    per_section = per_system.groupBy("section").agg(
        F.map_from_entries(F.collect_list(F.struct("system", "m"))).alias("systems"))
    return per_section.groupBy().agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("section", "systems"))))
        .alias("value"))


def write_report(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the report as one text file holding one JSON document."""
    report_json(metrics).coalesce(1).write.mode(mode).text(path)
