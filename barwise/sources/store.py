"""Bar store: Parquet by exchange, bucket of symbols, timeframe and month, with upserts that appear at once.

A symbol belongs to one of a fixed number of buckets, by hash. With a folder for each symbol a month has as many files as there
are symbols, of a few kilobytes each, and writing, committing and listing them outgrows the bars; buckets bound that number.
Rows lie by symbol and time, so a reader of one symbol prunes to its bucket's months and skips row groups by their bounds.

An upsert writes the months that it touches into a new version folder and then adds one commit file that names them; the newest
commit of a month says which version holds it. A commit file appears whole or not at all, and its number can be taken once, so
readers see all months of an upsert or none, a writer that dies leaves the old table, and of two writers the later one finds
that its number is gone and merges anew with what the other has stored.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.operators.bars import coverage
from barwise.operators.integrity import keep_last
from barwise.schemas import BAR, TIMEFRAMES, conform, require, require_zoned

PARTITIONS = ["exchange", "bucket", "timeframe", "ym"]
#: Buckets of symbols; a store keeps the number that it was made with.
BUCKETS = 128
_COMMIT = "commit long, version string, exchange string, bucket int, timeframe string, ym int, writer string, batch long"
#: How often an upsert merges anew when other writers were faster.
TRIES = 5


class ConflictError(RuntimeError):
    """Other writers took every number that an upsert tried for."""


def bucket_of(symbol: Column) -> Column:
    return F.pmod(F.hash(symbol), F.lit(BUCKETS))


class BarStore:
    """Reads prune months; writes replace the touched months only, later rows winning. The raw symbol stays a column."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> int:
        """The number of the newest commit, 0 without one."""
        fs, folder = self._fs(), self._path("_commits")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def _commit(self, number: int, lines: list[dict]) -> bool:
        """Adds commit ``number``; False if another writer has it."""
        fs, context = self._fs(), self.spark._jvm.org.apache.hadoop.fs.FileContext
        part, whole = self._path("_commits", f".{uuid.uuid4().hex}.part"), self._path("_commits", f"{number:020d}.json")
        out = fs.create(part, False)
        out.write("\n".join(json.dumps(x) for x in lines).encode())
        out.close()
        kind = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        option = self.spark._sc._gateway.new_array(kind, 1)
        option[0] = kind.NONE
        try:
            context.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(whole), option)
            return True
        except Py4JJavaError as e:
            fs.delete(part, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def commits(self, upto: int | None = None) -> DataFrame:
        """One row for each commit and month, to the newest or the given commit."""
        last = self._latest() if upto is None else upto
        if not last:
            return self.spark.createDataFrame([], _COMMIT)
        rows = self.spark.read.schema(_COMMIT).json(f"{self.root}/_commits").where(F.col("commit") <= last)
        # a store with a folder for each symbol must not look empty
        older = F.col("ym").isNotNull() & F.col("bucket").isNull()
        return rows.withColumn("bucket", F.when(older, F.raise_error(F.lit("this store has a folder for each symbol; write its bars into a new one"))).otherwise(F.col("bucket")))

    def _table(self, upto: int | None = None) -> DataFrame | None:
        """The rows of all months as of a commit, with the partition columns."""
        last = self._latest() if upto is None else upto
        if not last:
            return None
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BAR if f.name not in ("exchange", "timeframe"))
        rows = self.spark.read.schema(f"{ddl}, version string, exchange string, bucket int, timeframe string, ym int").parquet(f"{self.root}/data")
        live = self.commits(last).where("ym IS NOT NULL").groupBy(*PARTITIONS).agg(F.max_by("version", "commit").alias("version"))
        return rows.join(live, [*PARTITIONS, "version"], "left_semi").drop("version")

    def read(self, exchange: str, symbol: str | None, timeframe: str, start=None, end=None) -> DataFrame:
        """Bars from start to end, both included, by time; an unknown symbol has none, no symbol stands for all."""
        table = self._table()
        if table is None:
            return self.spark.createDataFrame([], BAR)
        rows = table.where((F.col("exchange") == exchange) & (F.col("timeframe") == timeframe))
        if symbol is not None:
            rows = rows.where((F.col("bucket") == bucket_of(F.lit(symbol))) & (F.col("symbol") == symbol))
        for bound, op in ((start, ">="), (end, "<=")):
            if bound is not None:
                at = F.lit(bound).cast("timestamp")
                rows = rows.where(F.col("ts") >= at if op == ">=" else F.col("ts") <= at)
                month = F.date_format(at, "yyyyMM").cast("int")
                rows = rows.where(F.col("ym") >= month if op == ">=" else F.col("ym") <= month)
        return rows.select(*BAR.names).orderBy("ts")

    def write(self, bars: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Upserts bars (exchange, symbol, timeframe, ts, open..volume); of rows with one key the greatest order stays.

        Without an order the greatest (close, volume, open, high, low, oi) stays, which no repeated task can change. batch is the
        name of a writer and the number of its batch: one that is stored already changes nothing, nor does an older one.

        Returns the number of different incoming bars, 0 for a repeated batch.
        """
        require_zoned(require(bars, ["exchange", "symbol", "timeframe", "ts", "open", "high", "low", "close", "volume"]))
        own = conform(bars, BAR).withColumn("_order", F.col(order).cast("long") if order else F.lit(0).cast("long"))
        own = own.withColumn("bucket", bucket_of(F.col("symbol"))).withColumn("ym", F.date_format("ts", "yyyyMM").cast("int")).withColumn("_new", F.lit(1))
        key = ["exchange", "symbol", "timeframe", "ts"]
        values = ["close", "volume", "open", "high", "low", "oi"]
        own = keep_last(own, key, [F.col("_order"), *values]).cache()
        try:
            months = [r.asDict() for r in own.groupBy(*PARTITIONS).agg(F.count("*").alias("_n")).collect()]
            count = sum(m.pop("_n") for m in months)
            for _ in range(TRIES if count else 0):
                base = self._latest()
                if batch is not None and self.commits(base).where((F.col("writer") == batch[0]) & (F.col("batch") >= batch[1])).limit(1).count():
                    return 0
                rows, table = own, self._table(base)
                if table is not None:
                    held = table.join(own.select(*PARTITIONS).distinct(), PARTITIONS, "left_semi").withColumn("_order", F.lit(0).cast("long")).withColumn("_new", F.lit(0))
                    rows = keep_last(held.unionByName(own), key, [F.col("_new"), F.col("_order")])
                version = uuid.uuid4().hex
                # a month of a bucket is one file, or several where it is large
                out = rows.drop("_order", "_new").hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, "symbol", "ts")
                out.write.option("compression", "zstd").partitionBy(*PARTITIONS).parquet(f"{self.root}/data/version={version}")
                writer, number = batch or (None, None)
                if self._commit(base + 1, [{"commit": base + 1, "version": version, **m, "writer": writer, "batch": number} for m in months]):
                    return count
                self._fs().delete(self._path("data", f"version={version}"), True)
            if count:
                raise ConflictError(f"{TRIES} commits after {self._latest()} went to other writers")
            return 0
        finally:
            own.unpersist()

    def vacuum(self, keep: int = 10) -> int:
        """Deletes months that a commit has replaced, but for the newest ``keep`` commits' predecessors, which readers may still use."""
        rows = self.commits(max(0, self._latest() - keep)).where("ym IS NOT NULL")
        if not rows.limit(1).count():
            return 0
        live = rows.groupBy(*PARTITIONS).agg(F.max("commit").alias("_live"))
        old = rows.join(live, PARTITIONS).where("commit < _live")
        fs, gone = self._fs(), 0
        for r in old.toLocalIterator():
            gone += fs.delete(self._path("data", f"version={r['version']}", *(f"{p}={r[p]}" for p in PARTITIONS)), True)
        return gone

    def coverage(self) -> DataFrame:
        table = self._table()
        keys = ["exchange", "symbol", "timeframe"]
        return coverage(table if table is not None else self.spark.createDataFrame([], BAR), keys)

    def symbols(self, exchange: str) -> list[str]:
        table = self._table()
        return [] if table is None else sorted(r[0] for r in table.where(F.col("exchange") == exchange).select("symbol").distinct().collect())

    def timeframes(self, exchange: str, symbol: str) -> list[str]:
        table = self._table()
        if table is None:
            return []
        rows = table.where((F.col("exchange") == exchange) & (F.col("bucket") == bucket_of(F.lit(symbol))) & (F.col("symbol") == symbol)).select("timeframe").distinct().collect()
        return sorted((r[0] for r in rows if r[0] in TIMEFRAMES), key=list(TIMEFRAMES).index)
