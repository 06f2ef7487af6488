"""What the operators of this subpackage share: tables, scratch folders, flat byte buffers and hashes."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


#: Rows and bytes that go to a Python worker at once; rows hold whole texts, and both sides hold a batch.
ARROW_ROWS, ARROW_BYTES = 500, 8 << 20


def _small_batches(spark: SparkSession) -> None:
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        held = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
        if not held or not 0 < int(held[1]) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's. One of its own is made in local mode only, as on a cluster no other process would see it."""
    _small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            found = tempfile.mkdtemp(prefix="spark-barwise-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


_recorders: list[list[str]] = []


@contextlib.contextmanager
def recording(paths: list[str]):
    """Inside, the paths of written() are added to paths."""
    _recorders.append(paths)
    try:
        yield
    finally:
        _recorders.remove(paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes recorded tables; for the caller to do once nothing reads them any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _recorders:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; counting stops just after them."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within the bound, else df for a shuffled join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; the keys of left stay."""
    own = right.select(*(F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(own, on, how).drop(*(f"_r_{k}" for k in keys))


#: A key with over 1/DEALT of all rows, and over LEAST_HOT, is dealt over several tasks.
DEALT, LEAST_HOT = 10_000, 1_000


def hot_keys(counts: DataFrame, keys: str | list[str], count: str, total: int) -> DataFrame:
    """(keys, parts) of those that hold over 1/DEALT of all rows and over LEAST_HOT rows: DEALT at most, so they are broadcast."""
    limit = max(LEAST_HOT, total // DEALT)
    keys = [keys] if isinstance(keys, str) else keys
    return F.broadcast(counts.where(F.col(count) > limit).select(*keys, F.ceil(F.col(count) / limit).cast("int").alias("parts")))


def dealt(left: DataFrame, right: DataFrame, keys: str | list[str], spread: str, hot: DataFrame) -> DataFrame:
    """left joined with right on keys. The left rows of a hot key go to its parts by a hash of ``spread``, right's to all of them."""
    keys = [keys] if isinstance(keys, str) else keys
    parts = F.coalesce("parts", F.lit(1))
    one = left.join(hot, keys, "left").withColumn("part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("parts")
    every = right.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return one.join(every, [*keys, "part"]).drop("part")


def fold() -> "F.Column":
    """crc32 of the decimal doc_id mod 5; fold 0 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 400_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of ``column``, one row at least, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = lengths(batch.column(column)).cumsum()
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lengths(array: pa.Array) -> np.ndarray:
    """Bytes of each value; null has none."""
    n = pa.compute.binary_length(array)
    return pa.compute.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array in one buffer, and n + 1 offsets into it; null is empty."""
    n = lengths(array)
    wide = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    wide = pa.compute.fill_null(wide, b"")
    wide = wide.combine_chunks() if isinstance(wide, pa.ChunkedArray) else wide
    ends = np.concatenate([[0], n.cumsum()]).astype(np.int64)
    if not len(n) or not ends[-1]:
        return np.zeros(0, np.uint8), ends
    first = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset]
    return np.frombuffer(wide.buffers()[2], np.uint8)[first : first + ends[-1]], ends


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values; a bijection."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Hash of any byte range of a buffer: sums of tabled byte values times powers of an odd base, modulo 2^64."""

    _powers: dict = {}

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.table = r.integers(1, 2**63, 256).astype(U64) | U64(1)
        self.base = (int(r.integers(1, 2**62)) << 2) | 3
        self.inverse = pow(self.base, -1, 2**64)

    def _power(self, base: int, n: int) -> np.ndarray:
        got = Rolling._powers.get(base)
        if got is None or len(got) < n:
            grown = np.full(max(n + n // 4, 1 << 19), base, U64)
            grown[0] = 1
            got = Rolling._powers[base] = np.multiply.accumulate(grown)
        return got[:n]

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.table[data] * self._power(self.inverse, len(data)), out=out[1:])
        return out

    def of(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (sums[hi] - sums[lo]) * self._power(self.base, len(sums))[lo]

    def every(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Of each k bytes in turn."""
        n = len(sums) - k
        return (sums[k:] - sums[:n]) * self._power(self.base, len(sums))[:n]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i with a whole window."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
