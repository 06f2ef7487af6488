"""What the operators on vectors share: which rows take part, whole components, matrices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Components of 2^24 / 256 and more in size count as that, so that sums of products stay in 64 bits.
LIMIT = 1 << 24


def whole(df: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector and all of its components are there and finite."""
    return df.where(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def scaled(column: str = "embedding") -> Column:
    """floor(256 x) of each component x, taken as a double."""
    return F.transform(column, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(SCALE * x.cast("double")))).cast("int"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of a matrix; shorter ones end in zeros."""
    n = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pa.compute.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(n) or (n == width).all():
        return values.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(n.cumsum() - n, n)] = values
    return out


def gathered(batches: Iterator[pa.RecordBatch], width: int, values: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about so many values of vectors as wide as that."""
    own, rows, most = [], 0, max(1, values // max(1, width))
    for batch in batches:
        own.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield pa.Table.from_batches(own).combine_chunks().to_batches()[0] if len(own) > 1 else batch
            own, rows = [], 0
    if rows:
        yield pa.Table.from_batches(own).combine_chunks().to_batches()[0]


def widest(df: DataFrame, column: str) -> int:
    return int(df.agg(F.coalesce(F.max(F.size(column)), F.lit(0))).first()[0])
