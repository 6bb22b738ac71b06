"""Vector columns as numpy matrices, for operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_rows(table: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is neither null nor holds a null or non-finite entry."""
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == float("inf")))
    return table.filter(vector.isNotNull() & ~bad)


def common_length(vectors: DataFrame, vector_col: str) -> int:
    """The length that most vectors have (of equally frequent ones the longest); 0 without rows."""
    lengths = vectors.groupBy(F.size(vector_col).alias("size")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    return first["size"] if first else 0


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """The list column of one batch as rows of doubles; all lists have ``width`` entries."""
    values = pc.cast(column.flatten(), pa.float64())
    return values.to_numpy(zero_copy_only=False).reshape(len(column), width)


def matrices(batches: Iterable[pa.RecordBatch], vector_col: str, width: int,
             rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, matrix_of(part.column(part.schema.get_field_index(vector_col)), width)
