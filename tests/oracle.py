"""Compare a Spark result with the DuckDB result of its SQL twin."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(value) -> object:
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(_kind(v) for v in value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def _rows(names, tuples) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_kind(t[i]) for i in order) for t in tuples)


def _families(names, types) -> dict[str, str]:
    def family(t: str) -> str:
        t = t.lower()
        if any(x in t for x in ("bigint", "long", "int", "short", "byte")) and "interval" not in t:
            return "integer"
        if "double" in t or "float" in t or "decimal" in t:
            return "number"
        if "bool" in t:
            return "boolean"
        if "varchar" in t or "string" in t:
            return "string"
        return t
    return {n: family(str(t)) for n, t in zip(names, types)}


def compare(spark_df, con, sql: str) -> tuple[int, list[str]]:
    """Row count and a list of differences (empty when equal)."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = _families(names, [d[1] for d in result.description])
    expected = _rows(names, result.fetchall())
    ours = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        problems.append(f"columns {sorted(spark_df.columns)} != {sorted(names)}")
    mine = _families(spark_df.columns, [f.dataType.simpleString() for f in spark_df.schema.fields])
    if kinds != mine:
        problems.append(f"types spark {mine} != oracle {kinds}")
    n, m = sum(ours.values()), sum(expected.values())
    if n != m:
        problems.append(f"rows {n} != {m}")
    if ours != expected:
        problems.append(f"only spark {list((ours - expected).items())[:3]}")
        problems.append(f"only oracle {list((expected - ours).items())[:3]}")
    return n, problems
