"""Vendors as Spark sources: history in planned chunks, and ticks or polled quotes as streams that can be read again.

A client is an object or a function that the tasks call; here it stands for a vendor's library. It comes as an option, either as
``module:name`` or as what packed() makes of it.

* ``barwise_history``: client(request) returns the bars of one chunk. Chunks are planned on the driver from the options and from
  what the query filters by, one partition each; none may span more days than the vendor allows.
* ``barwise_ticks``: client.latest() is the number of the newest entry and client.read(lo, hi) the entries lo < seq <= hi, as
  (seq, received_at, payload). The number is the stream's offset, so a query that restarts asks for what it had not finished.
* A vendor that only answers polls is made such a client by Polls: every poll is kept in a Journal before its number is given out.
"""

from __future__ import annotations

import base64
import datetime as dt
import importlib
import json
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from zoneinfo import ZoneInfo

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from barwise.operators.ingest import SPAN_DAYS
from barwise.schemas import BAR

ZONE = "Asia/Kolkata"
ENTRY = T.StructType([T.StructField("seq", T.LongType()), T.StructField("received_at", T.TimestampType()), T.StructField("payload", T.StringType())])
#: A history that reports failures has these before a bar's columns.
REPORTED = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("error", T.StringType()), *BAR.fields])


class SpanError(ValueError):
    """A chunk spans more days than one request may."""


def packed(client: Any) -> str:
    """A client as an option's text."""
    return "pickle:" + base64.b64encode(cloudpickle.dumps(client)).decode()


def unpacked(text: str) -> Any:
    kind, _, rest = text.partition(":")
    return cloudpickle.loads(base64.b64decode(rest)) if kind == "pickle" else getattr(importlib.import_module(kind), rest)


def instant(value: Any, zone: str) -> dt.datetime | None:
    """A vendor's time as an instant; one without zone is the exchange's."""
    if value is None:
        return None
    at = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
    return at if at.tzinfo else at.replace(tzinfo=ZoneInfo(zone))


class RateLimiter:
    """At most ``per_second`` calls a second from one task; a quota is kept by fetching in one partition for each."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.last = (1.0 / per_second if per_second > 0 else 0.0), clock, sleep, None

    def acquire(self) -> None:
        if self.last is not None and (wait := self.last + self.gap - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()


class ParquetReplay:
    """A client for barwise_history that replays bars stored as Parquet, a folder ``symbol=...`` for each, in a shared folder.

    It stands for a vendor: a request reads the days that it asks for of one symbol. ts is an instant; days are those of zone.
    """

    def __init__(self, folder: str, zone: str = ZONE):
        self.folder, self.zone = folder, zone

    def __call__(self, request: dict) -> list[dict]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as data
        import pyarrow.fs

        name = f"{self.folder}/symbol={request['symbol']}"
        fs, path = pyarrow.fs.FileSystem.from_uri(name if "://" in name or name.startswith("file:") else f"file://{name}")
        if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return []
        first = instant(request["first_day"], self.zone)
        last = instant(request["last_day"], self.zone) + dt.timedelta(days=1)
        rows = data.dataset(path, filesystem=fs, format="parquet").to_table(columns=["ts", "open", "high", "low", "close", "volume"])
        ts = rows.column("ts")
        # Parquet's older timestamps carry no zone and are UTC
        ts = pc.assume_timezone(ts, "UTC") if ts.type.tz is None else ts
        rows = rows.set_column(0, "ts", ts.cast(pa.timestamp("us", "UTC"), safe=False))
        edge = lambda t: pa.scalar(t.astimezone(dt.UTC), pa.timestamp("us", "UTC"))
        return rows.filter(pc.and_(pc.greater_equal(rows["ts"], edge(first)), pc.less(rows["ts"], edge(last)))).to_pylist()


class Requests(ds.InputPartition):
    """Chunks that one task asks for in turn."""

    def __init__(self, requests: list[dict]):
        self.requests = requests


def checked(request: dict, caps: dict[str, int]) -> dict:
    days = (dt.date.fromisoformat(request["last_day"]) - dt.date.fromisoformat(request["first_day"])).days + 1
    cap = caps.get(request["timeframe"])
    if cap is None:
        raise ValueError(f"unknown timeframe {request['timeframe']!r}")
    if days > cap:
        raise SpanError(f"{request['symbol']} {request['timeframe']}: {days} days from {request['first_day']}, {cap} at most")
    return request


class HistoryReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.client = options["client"]
        self.zone = options.get("zone", ZONE)
        self.report = options.get("report", "false").lower() == "true"
        self.caps = SPAN_DAYS | {k: int(v) for k, v in json.loads(options.get("caps", "{}")).items()}
        self.per_second = float(options.get("per_second", "3"))
        self.quotas = int(options.get("quotas", "0"))
        self.attempts = int(options.get("attempts", "1"))
        self.kept: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        """Which symbols are asked for, and which days; times within a day are left to Spark."""
        for f in filters:
            name = f.attribute if hasattr(f, "attribute") else ()
            bound = name == ("ts",) and isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual))
            named = name in (("symbol",), ("exchange",), ("timeframe",)) and isinstance(f, (ds.EqualTo, ds.In))
            if bound or named:
                self.kept.append(f)
            if not named:
                yield f

    def _fits(self, request: dict) -> bool:
        for f in self.kept:
            if f.attribute == ("ts",):
                day = instant(f.value, self.zone).astimezone(ZoneInfo(self.zone)).date().isoformat()
                lower = isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo))
                upper = isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo))
                if (lower and request["last_day"] < day) or (upper and request["first_day"] > day):
                    return False
            elif request[f.attribute[0]] not in (f.value if isinstance(f, ds.In) else (f.value,)):
                return False
        return True

    def _planned(self) -> Iterator[dict]:
        """A given plan, or chunks of the options' range; those without a trading day are left out."""
        o = self.options
        if "plan" in o:
            yield from json.loads(o["plan"])
            return
        closed = set(filter(None, o.get("holidays", "").split(",")))
        first, last = dt.date.fromisoformat(o["start"]), dt.date.fromisoformat(o["end"])
        cap = self.caps.get(o["timeframe"], 1)
        stride = int(o.get("chunk_days", cap))
        for symbol in o["symbols"].split(","):
            for chunk, ahead in enumerate(range(0, (last - first).days + 1, stride)):
                days = [first + dt.timedelta(i) for i in range(ahead, min(ahead + stride, (last - first).days + 1))]
                own = [d.isoformat() for d in days if d.weekday() < 5 and d.isoformat() not in closed]
                if own:
                    yield {"chunk": chunk, "exchange": o.get("exchange", "NSE"), "symbol": symbol.strip(), "timeframe": o["timeframe"], "first_day": own[0], "last_day": own[-1]}

    def partitions(self) -> list[Requests]:
        """One for each chunk, or the chunks dealt over as many as there are quotas. A chunk over the cap stops the query here."""
        own = [checked(r, self.caps) for r in self._planned() if self._fits(r)]
        if not self.quotas:
            return [Requests([r]) for r in own] or [Requests([])]
        return [Requests(own[i :: self.quotas]) for i in range(min(self.quotas, max(1, len(own))))]

    def read(self, partition: Requests) -> Iterator[tuple]:
        client, limiter = unpacked(self.client), RateLimiter(self.per_second / max(1, self.quotas))
        for request in partition.requests:
            checked(request, self.caps)
            rows, error = [], None
            for attempt in range(self.attempts):
                limiter.acquire()
                try:
                    rows, error = list(client(dict(request))), None
                    break
                except Exception as e:  # noqa: BLE001  a vendor's client may raise anything; what is left of it is reported or raised
                    error = e
            if error is not None and not self.report:
                raise error
            head = (request["exchange"], request["symbol"], request["timeframe"])
            if error is not None:
                yield (request["chunk"], f"{type(error).__name__}: {error}", *head, *[None] * (len(BAR) - 3))
            for r in rows:
                prices = [None if r.get(k) is None else float(r[k]) for k in ("open", "high", "low", "close")]
                counts = [None if r.get(k) is None else int(r[k]) for k in ("volume", "oi")]
                bar = (*head, instant(r["ts"], self.zone), *prices, *counts)
                yield (request["chunk"], None, *bar) if self.report else bar


class HistorySource(ds.DataSource):
    """Options: client; symbols, timeframe, start, end (and exchange, holidays, chunk_days) or plan; caps, zone, per_second,
    quotas, attempts, report. A failed chunk fails its task, which Spark repeats; with report it gives a row with its error."""

    @classmethod
    def name(cls) -> str:
        return "barwise_history"

    def schema(self) -> T.StructType:
        return REPORTED if self.options.get("report", "false").lower() == "true" else BAR

    def reader(self, schema: T.StructType) -> HistoryReader:
        return HistoryReader(dict(self.options))


class Entries(ds.InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class TickReader(ds.DataSourceStreamReader):
    def __init__(self, options: dict):
        self.client = unpacked(options["client"])
        self.first = int(options.get("from_seq", "0"))
        self.size = max(1, int(options.get("entries_per_partition", "10000")))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"seq": max(self.first, int(self.client.latest()))}

    def partitions(self, start: dict, end: dict) -> list[Entries]:
        return [Entries(lo, min(lo + self.size, end["seq"])) for lo in range(start["seq"], end["seq"], self.size)]

    def read(self, partition: Entries) -> Iterator[tuple]:
        for seq, at, payload in self.client.read(partition.lo, partition.hi):
            if not partition.lo < seq <= partition.hi:
                raise ValueError(f"entry {seq} is not in ({partition.lo}, {partition.hi}]")
            yield seq, instant(at, ZONE), payload

    def commit(self, end: dict) -> None:
        done = getattr(self.client, "commit", None)
        if done:
            done(end["seq"])


class TickSource(ds.DataSource):
    """Options: client, from_seq, entries_per_partition. Rows (seq, received_at, payload) as for vendor.ticks_from_payload()."""

    @classmethod
    def name(cls) -> str:
        return "barwise_ticks"

    def schema(self) -> T.StructType:
        return ENTRY

    def streamReader(self, schema: T.StructType) -> TickReader:  # noqa: N802
        return TickReader(dict(self.options))


class Journal:
    """Numbered entries in a folder that driver and executors share, a file of JSON lines for each append.

    A file is named by its first and last number and appears at once, whole, so a reader never sees half an append. One process
    appends; any number read.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _fs(self):
        import pyarrow.fs

        return pyarrow.fs.FileSystem.from_uri(self.folder)

    def _files(self) -> list[tuple[int, int, str]]:
        import pyarrow.fs

        fs, path = self._fs()
        found = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
        return sorted((*map(int, f.base_name[:-5].split("-")), f.path) for f in found if f.base_name.endswith(".json"))

    def latest(self) -> int:
        return max((hi for _, hi, _ in self._files()), default=0)

    def append(self, entries: list[tuple[Any, str]]) -> int:
        """Adds (received_at, payload) entries; the number of the last one."""
        if not entries:
            return self.latest()
        fs, path = self._fs()
        fs.create_dir(path)
        first = self.latest() + 1
        last = first + len(entries) - 1
        text = "\n".join(json.dumps([first + i, str(at) if at is not None else None, payload]) for i, (at, payload) in enumerate(entries))
        with fs.open_output_stream(f"{path}/.{first:015d}.part") as out:
            out.write(text.encode())
        fs.move(f"{path}/.{first:015d}.part", f"{path}/{first:015d}-{last:015d}.json")
        return last

    def read(self, lo: int, hi: int) -> Iterator[tuple]:
        fs, _ = self._fs()
        for first, last, path in self._files():
            if last <= lo or first > hi:
                continue
            with fs.open_input_stream(path) as got:
                for line in got.read().decode().split("\n"):
                    seq, at, payload = json.loads(line)
                    if lo < seq <= hi:
                        yield seq, at, payload


class Polls:
    """A client for barwise_ticks over a vendor that only answers polls: quotes() gives the payloads of one poll.

    At most one poll is made in ``seconds``; its quotes are in the journal before the stream hears of them, so a restarted query
    reads the same ones again and no poll is counted twice.
    """

    def __init__(self, quotes: Callable[[], list[str]], journal: Journal, seconds: float = 1.0, clock: Callable[[], float] = time.time):
        self.quotes, self.journal, self.seconds, self.clock, self.last = quotes, journal, seconds, clock, None

    def latest(self) -> int:
        now = self.clock()
        if self.last is None or now - self.last >= self.seconds:
            self.last = now
            at = dt.datetime.fromtimestamp(now, dt.UTC).isoformat()
            return self.journal.append([(at, q) for q in self.quotes()])
        return self.journal.latest()

    def read(self, lo: int, hi: int) -> Iterator[tuple]:
        return self.journal.read(lo, hi)


def register(spark: SparkSession) -> None:
    """Makes the sources known to spark.read and spark.readStream, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (HistorySource, TickSource):
        spark.dataSource.register(source)


def history(spark: SparkSession, client: Any, symbols: list[str], timeframe: str, start, end, **options: Any) -> DataFrame:
    """Bars of symbols from start to end from a vendor; filters on symbol and ts decide which chunks are asked for."""
    register(spark)
    given = {"client": client if isinstance(client, str) else packed(client), "symbols": ",".join(symbols), "timeframe": timeframe, "start": str(start), "end": str(end)}
    return spark.read.format("barwise_history").options(**given, **options).load()


def feed(spark: SparkSession, client: Any, **options: Any) -> DataFrame:
    """A stream of a feed's entries (seq, received_at, payload)."""
    register(spark)
    return spark.readStream.format("barwise_ticks").options(client=client if isinstance(client, str) else packed(client), **options).load()
