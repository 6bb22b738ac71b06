"""Helpers shared by the corpus operators: scratch tables, Arrow batches, words."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from replyloom.session import scratch_path, ship_package

#: Rows handled at a time inside a Python task, whatever the size of the Arrow batch.
SLICE_ROWS = 256

#: A word everywhere in this package: a run of anything but blank, tab, LF, VT, FF and CR.
#: ``bytes.split()`` without arguments cuts at exactly these six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written below ``spark.checkpoint.dir`` and removed together.

    Operators that iterate write their intermediate tables here, so a lost executor costs a
    reread and not a recomputation. ``finish`` writes the result elsewhere and drops the rest.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = scratch_path(spark, label)
        self._tables: list[str] = []
        self._written: list[tuple[DataFrame, str]] = []
        ship_package(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        self._release()
        table = self.spark.read.schema(df.schema).parquet(path)
        self._written.append((table, path))
        return table

    def forget(self, *tables: DataFrame) -> None:
        """Delete tables of :meth:`write` that no later step reads."""
        for table in tables:
            for entry in [e for e in self._written if e[0] is table]:
                delete_folder(self.spark, entry[1])
                self._written.remove(entry)

    def write_bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """A table whose buckets by ``key`` later joins read without a shuffle."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"scratch_{uuid.uuid4().hex}"
        df.write.option("path", self.path("bucketed")).bucketBy(buckets, key).sortBy(
            key).saveAsTable(table)
        self._tables.append(table)
        self._release()
        return self.spark.table(table)

    def _release(self) -> None:
        """Let Spark delete the shuffle files of earlier steps now.

        It does so when the driver collects its garbage, which a driver that holds little does
        seldom; without this an operator of many steps keeps the files of all of them.
        """
        self.spark._jvm.System.gc()

    def finish(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "result")
        df.write.parquet(path)
        self.drop()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for table in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_folder(self.spark, self.root)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of this package through the file system that Spark itself uses."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def byte_slices(batches: Iterable[pa.RecordBatch], text_col: str = "text",
                rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Small slices of the batches, each with its texts as UTF-8 bytes (null as empty)."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            texts = part.column(part.schema.get_field_index(text_col)).cast(pa.binary())
            yield part, [x or b"" for x in texts.to_pylist()]


def field(df: DataFrame, name: str) -> str:
    """``name type`` of a column, for the schema string of an Arrow function."""
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def frame(part: pa.RecordBatch, keep: Iterable[str], more: dict[str, Any]) -> pa.RecordBatch:
    """A batch of some columns of ``part`` followed by new ones."""
    names = list(keep)
    arrays = [part.column(part.schema.get_field_index(n)) for n in names]
    for name, values in more.items():
        names.append(name)
        arrays.append(values if isinstance(values, pa.Array) else pa.array(values))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def count_words(docs: DataFrame, keep: list[str], text_col: str = "text",
                with_digest: bool = False) -> DataFrame:
    """The columns ``keep``, ``n_words`` of the whole text (null: 0) and ``text_key``, a 64-bit
    hash of the text. ``with_digest`` adds ``digest``, the SHA-256 of the text lower-cased in A-Z.
    """
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_slices(batches, text_col):
            more = {"n_words": pa.array([len(t.split()) for t in texts], pa.int64()),
                    "text_key": pa.array([signed(xxhash.xxh3_64_intdigest(t)) for t in texts],
                                         pa.int64())}
            if with_digest:
                more["digest"] = pa.array(
                    [hashlib.sha256(t.lower()).hexdigest() for t in texts], pa.string())
            yield frame(part, keep, more)

    ship_package(docs.sparkSession)
    schema = [field(docs, c) for c in keep] + ["n_words long", "text_key long"]
    return docs.select(*keep, text_col).mapInArrow(
        counted, ", ".join(schema + ["digest string"] * with_digest))


def signed(value: int) -> int:
    """An unsigned 64-bit integer as Spark's signed one."""
    return value - (1 << 64) if value >> 63 else value
