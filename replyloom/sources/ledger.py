"""An append-once store whose runs are committed one after the other.

    <path>/rows/run=<id>/     rows of a run, Parquet
    <path>/keys/run=<id>/     their keys, bucketed by the key's hash
    <path>/commits/<n>        one small file for each committed run, numbered without gaps

New rows are shuffled to the buckets and meet the stored keys there: the stored side is neither
shuffled nor broadcast, and of the rows only the keys are read. A run becomes visible when its
commit file appears, which is created last and only if no other run has taken its number. A run
that finds its number taken drops the rows that the other runs have stored meanwhile, and tries the
next one, so two runs at a time store a key once. What a lost run has written is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Buckets of the stored keys; fixed when the store is made.
BUCKETS = 64


class _Folder:
    """Small files of a store, through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; False if it does.

        The text is written aside and renamed, so that no reader sees half of it. The rename fails
        if the name is taken.
        """
        aside = self._path(f".{uuid.uuid4().hex}")
        self._fs.mkdirs(self._path(name).getParent())
        stream = self._fs.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._root.toUri(), self._conf)
        none = self._jvm.java.lang.reflect.Array.newInstance(
            self._jvm.org.apache.hadoop.fs.Options.Rename.NONE.getClass(), 0)
        qualified = [self._fs.makeQualified(p) for p in (aside, self._path(name))]
        try:
            context.rename(*qualified, none)
            return True
        except Exception:
            if not self._fs.exists(self._path(name)):
                raise
            self._fs.delete(aside, False)
            return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Commit:
    number: int
    run: str
    rows: int


class Ledger:
    """The store below ``path``; ``schema`` are its rows, ``key`` is a string column of them."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "pair_id",
                 buckets: int = BUCKETS) -> None:
        if not isinstance(schema[key].dataType, T.StringType):
            raise ValueError(f"the key {key!r} has to be a string")
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._folder = _Folder(spark, path)
        made = {"buckets": buckets, "key": key}
        if not self._folder.create("store.json", json.dumps(made)):
            made = json.loads(self._folder.read("store.json"))
        if made["key"] != key:
            raise ValueError(f"the store is keyed by {made['key']!r}")
        self.buckets = made["buckets"]
        self._defined: list[str] = []

    def commits(self) -> list[Commit]:
        """Committed runs in their order; one small file is read for each."""
        numbers = sorted(int(n) for n in self._folder.names("commits") if n.isdigit())
        found = []
        for number in numbers:
            body = json.loads(self._folder.read(f"commits/{number:010d}"))
            found.append(Commit(number, body["run"], body["rows"]))
        return found

    def rows(self) -> DataFrame:
        """Rows of all committed runs."""
        runs = [f"{self.path}/rows/run={c.run}" for c in self.commits() if c.rows]
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*runs)

    def _keys(self, runs: list[str]) -> DataFrame:
        """Stored keys of some runs as a bucketed table; the definition is this session's own."""
        name = f"ledger_{uuid.uuid4().hex}"
        self._defined.append(name)
        self.spark.sql(
            f"CREATE TABLE {name} (stored_key STRING, run STRING) USING PARQUET "
            f"OPTIONS (path '{self.path}/keys') PARTITIONED BY (run) "
            f"CLUSTERED BY (stored_key) INTO {self.buckets} BUCKETS")
        for run in runs:
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (run='{run}') "
                           f"LOCATION '{self.path}/keys/run={run}'")
        return self.spark.table(name)

    def _without(self, df: DataFrame, runs: list[str]) -> DataFrame:
        if not runs:
            return df
        keyless = F.col(self.key).isNull() | (F.col(self.key) == "")
        # Rows without a key travel under a hash of their content, so they do not pile up.
        left = df.withColumn("__key", F.when(keyless, F.xxhash64(*df.columns).cast("string"))
                             .otherwise(F.col(self.key))).withColumn("__keyless", keyless)
        stored = self._keys(runs).select("stored_key").hint("merge")
        known = (left["__key"] == stored["stored_key"]) & ~left["__keyless"]
        return left.join(stored, known, "left_anti").drop("__key", "__keyless")

    def missing(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose key is not stored; rows without a key are always missing."""
        return self._without(df, [c.run for c in self.commits() if c.rows])

    def append(self, df: DataFrame) -> int:
        """Store the rows that are missing, in one commit; returns how many they were.

        Of rows of ``df`` that share a key one is stored. Rows without a key are always stored.
        """
        before = self.commits()
        keyless = F.col(self.key).isNull() | (F.col(self.key) == "")
        todo = self._without(df.select(*self.schema.names), [c.run for c in before if c.rows])
        # In one pass, since the rows may come from a costly model.
        alone = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
        todo = todo.withColumn("__once", F.when(keyless, alone).otherwise(F.col(self.key))
                               ).dropDuplicates(["__once"]).drop("__once")
        run, n = self._write(todo)
        while not self._folder.create(f"commits/{len(before):010d}",
                                      json.dumps({"run": run, "rows": n})):
            # Another run was faster: what it stored is stored once.
            now = self.commits()
            theirs = [c.run for c in now[len(before):] if c.rows]
            before = now
            if n and theirs:
                mine = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/run={run}")
                lost, (run, n) = run, self._write(self._without(mine, theirs))
                self._forget(lost)
        return n

    def _write(self, todo: DataFrame) -> tuple[str, int]:
        run = uuid.uuid4().hex
        where = f"{self.path}/rows/run={run}"
        todo.write.parquet(where)
        stored = self.spark.read.schema(self.schema).parquet(where)
        n = stored.count()
        keys = stored.where(F.col(self.key).isNotNull() & (F.col(self.key) != "")).select(
            F.col(self.key).alias("stored_key"))
        name = f"ledger_{uuid.uuid4().hex}"
        # In the buckets' own partitions, so every bucket of a run is one file.
        (keys.repartition(self.buckets, "stored_key").write
         .option("path", f"{self.path}/keys/run={run}").bucketBy(self.buckets, "stored_key")
         .sortBy("stored_key").saveAsTable(name))
        self.spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
        return run, n

    def close(self) -> None:
        """Drop the table definitions that plans of this object used; no file is deleted."""
        for name in self._defined:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._defined.clear()

    def _forget(self, run: str) -> None:
        self._folder.delete(f"rows/run={run}")
        self._folder.delete(f"keys/run={run}")

    def drop_lost_runs(self) -> int:
        """Delete what runs without a commit have left. Call it while no run is at work."""
        known = {c.run for c in self.commits()}
        lost = {n.removeprefix("run=") for f in ("rows", "keys") for n in self._folder.names(f)
                if n.startswith("run=")} - known
        for run in lost:
            self._forget(run)
        return len(lost)
