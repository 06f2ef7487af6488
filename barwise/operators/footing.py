"""Whether totals equal the sum of their items.

A column of a page is a sequence of figures, read downwards. What stands open is a stack of entries: figures, and groups that
were already added up and count as one figure since; beside it the number and the sum of the plain figures at its end. A row of
the column turns that state into the next one. Spark brings the rows of a page together in order, and its tasks fold them as
they come: a plain row looks at the two numbers only; a total walks up the entries once, adding as it goes, and stops at the end
that adds up. What a row costs does not follow the length of its column, and only what stands open is kept.

=========  ==========================================  ===================  =====================================
row        what it is measured against                 outcome              what stands open afterwards
=========  ==========================================  ===================  =====================================
total      shortest end of the entries that adds up,   ok                   the end gives way to one closed entry
           not beyond a derived figure
total      else the plain figures at the end, or the   error                they give way to the sum they had
           last two closed groups
total      neither                                     unverified           a closed entry is added
derived    -                                           -                    a closed entry that nothing reaches over
plain      two or more plain figures at the end, if    ok, implicit         they give way to one closed entry
           they add up to it; else nothing             -                    a plain entry is added
=========  ==========================================  ===================  =====================================
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.functions import numbers as num

#: Figures that a total looks back over.
LOOK_BACK = 80
IMPLICIT = "(implicit subtotal)"
_PLACE = "row_no:int,label:string,value:double,x0:double,top:double"
_CHECK = f"row_no int, label string, kind string, status string, stated double, expected double, x0 double, top double, components array<struct<{_PLACE}>>"
_KIND, _STATUS = pa.array(["total", "implicit"]), pa.array(["ok", "error", "unverified"])
_TOTAL, _IMPLICIT_SUM = range(2)
_OK, _ERROR, _UNVERIFIED = range(3)
#: Rows, and entries: figures stand open or were closed, some under a name of their own; nothing reaches over derived ones.
_PLAIN, _DERIVED, _IS_TOTAL = range(3)
_OPEN, _CLOSED, _NAMED, _WALL = range(4)
#: Rows that are kept beyond twice those that stand open, and batches that they lie in, before the others go.
_SPARE, _BATCHES = 20_000, 64


def _sum(values: list[float]) -> float:
    total = 0.0
    for x in values:  # one after the other: sum() rounds in its own way
        total += x
    return total


class _Found:
    """Checks of a batch: the row of each, its page, what came out, and where its components end among all of them."""

    def __init__(self):
        self.rows, self.pages, self.kinds, self.statuses, self.expected, self.ends = [], [], [], [], [], [0]
        self.values, self.places = [], []

    def add(self, row: int, page: int, kind: int, status: int, expected: float, values: list[float], places: list[int]) -> None:
        self.rows.append(row)
        self.pages.append(page)
        self.kinds.append(kind)
        self.statuses.append(status)
        self.expected.append(expected)
        self.values += values
        self.places += places
        self.ends.append(len(self.places))


class _Fold:
    """The fold over a task's rows, which come page by page, and column by column inside.

    An entry is a value and a place: four times its row's number among those that are kept, and how it stands.
    """

    def __init__(self, base: float):
        self.base, self.page, self.last = base, 0, (0, -1)
        self.kept: list[pa.RecordBatch] = []
        self._open()

    def _open(self) -> None:
        """A column begins. groups and walls are where closed and derived figures stand among the entries."""
        self.values, self.places, self.groups, self.walls, self.tail, self.tail_sum = [], [], [], [], 0, 0.0

    def _close(self, n: int, row: int, value: float, mark: int = _CLOSED) -> None:
        """The last n entries give way to one."""
        cut = len(self.values) - n
        if n:
            del self.values[cut:], self.places[cut:]
            for at in (self.groups, self.walls):
                while at and at[-1] >= cut:
                    at.pop()
        (self.walls if mark == _WALL else self.groups).append(cut)
        self.values.append(value)
        self.places.append(4 * row + mark)

    def _end(self, value: float) -> int:
        """How many entries at the end add up to a total, 0 if none do. A derived figure may be the last of them, with nothing
        beyond it; a NaN counts as adding up, as it does for SQL."""
        off = 1e-9 * abs(value)
        total, low = 0.0, max(0, len(self.values) - LOOK_BACK, self.walls[-1] if self.walls else 0)
        for n, x in enumerate(reversed(self.values[low:]), 1):
            total += x
            if abs(total - value) <= self.base + 0.5 * n + off or off != off:
                return n
        return 0

    def _total(self, i: int, row: int, value: float, found: _Found) -> None:
        n, values, places = self._end(value), self.values, self.places
        status, expected, close = _OK, value, value
        if n:
            expected = _sum(values[-n:])
        elif self.tail >= 2:
            n, status, expected = self.tail, _ERROR, self.tail_sum
            close = expected
        elif not self.tail and len(self.groups) >= 2:
            b, a = self.groups.pop(), self.groups.pop()
            expected = _sum([values[a], values[b]])
            found.add(i, self.page, _TOTAL, _ERROR, expected, [values[a], values[b]], [places[a], places[b]])
            for k in (b, a):
                del values[k], places[k]
                for w in range(len(self.walls) - 1, -1, -1):
                    if self.walls[w] < k:
                        break
                    self.walls[w] -= 1
            return self._close(0, row, expected)
        else:
            status = _UNVERIFIED
        cut = len(values) - n
        found.add(i, self.page, _TOTAL, status, expected, values[cut:], places[cut:])
        self._close(n, row, close)

    def _rows(self, i: int, first: int, is_a: list[int], figures: list[float], blank: list[bool], found: _Found) -> None:
        """Folds rows of one column, from the i-th of a batch on, which stands at first among those that are kept."""
        base, values, places, tail, tail_sum = self.base, self.values, self.places, self.tail, self.tail_sum
        for i, (kind, value) in enumerate(zip(is_a, figures), i):
            if kind == _PLAIN:
                if tail > 1:
                    most = base + 0.5 * tail + 1e-9 * abs(value)
                    if abs(tail_sum - value) <= most or most != most:
                        found.add(i, self.page, _IMPLICIT_SUM, _OK, tail_sum, values[-tail:], places[-tail:])
                        self._close(tail, first + i, value, _NAMED if blank[i] else _CLOSED)
                        tail, tail_sum = 0, 0.0
                        continue
                values.append(value)
                places.append(4 * (first + i))
                tail += 1
                tail_sum += value
                continue
            if kind == _IS_TOTAL:
                self.tail, self.tail_sum = tail, tail_sum
                self._total(i, first + i, value, found)
            else:
                self._close(0, first + i, value, _WALL)
            tail, tail_sum = 0, 0.0
        self.tail, self.tail_sum = tail, tail_sum

    def checks(self, batch: pa.RecordBatch) -> tuple[_Found, pa.Table]:
        """The checks of a batch's rows, and the rows that their components are among."""
        first, found = sum(b.num_rows for b in self.kept), _Found()
        self.kept.append(batch.select(["row_no", "label", "x0", "top"]))
        place, column = batch["place"].to_numpy(), pc.fill_null(batch["column"].cast(pa.int64()), -1 << 40).to_numpy()
        before = np.concatenate([[self.last], np.stack([place, column], 1)[:-1]])
        pages = place == 1
        if not (pages | (place == before[:, 0] + 1)).all():
            raise ValueError("the rows of a page do not come in order")
        begins = np.flatnonzero(pages | (column != before[:, 1])).tolist()
        pages, blank = pages.tolist(), pc.equal(batch["label"], "").to_numpy(zero_copy_only=False).tolist()
        is_a, figures = batch["is_a"].to_numpy().tolist(), batch["value"].to_numpy().tolist()
        ends = [*begins, len(figures)]
        self._rows(0, first, is_a[: ends[0]], figures[: ends[0]], blank, found)
        for a, b in zip(begins, ends[1:]):
            self._open()
            self.page += pages[a]
            self._rows(a, first, is_a[a:b], figures[a:b], blank, found)
        self.last = (place[-1], column[-1])
        kept = pa.Table.from_batches(self.kept)
        if kept.num_rows > 2 * len(self.places) + _SPARE or len(self.kept) > _BATCHES:
            at = np.array(self.places, np.int64)
            self.kept = kept.take(pa.array(at // 4)).combine_chunks().to_batches()
            self.places = (4 * np.arange(len(at)) + at % 4).tolist()
        return found, kept


def _table(batch: pa.RecordBatch, found: _Found, kept: pa.Table) -> pa.RecordBatch:
    own = batch.take(pa.array(found.rows, pa.int64()))
    places = np.array(found.places, np.int64)
    parts = kept.take(pa.array(places // 4)).combine_chunks()
    parts = {c: parts[c].combine_chunks() for c in parts.column_names}
    parts["value"] = pa.array(found.values, pa.float64())
    parts["label"] = pc.if_else(pa.array(places % 4 == _NAMED), IMPLICIT, parts["label"])
    kinds = pa.array(found.kinds, pa.int8())
    nameless = pc.and_(pc.equal(kinds, _IMPLICIT_SUM), pc.equal(own["label"], ""))
    names = ["row_no", "label", "value", "x0", "top"]
    columns = {c: own[c] for c in ("doc_id", "page_index", "column", "row_no")} | {
        "label": pc.if_else(nameless, IMPLICIT, own["label"]),
        "kind": _KIND.take(kinds),
        "status": _STATUS.take(pa.array(found.statuses, pa.int8())),
        "stated": own["value"],
        "expected": pa.array(found.expected, pa.float64()),
        "x0": own["x0"],
        "top": own["top"],
        "components": pa.ListArray.from_arrays(pa.array(found.ends, pa.int32()), pa.StructArray.from_arrays([parts[c] for c in names], names)),
    }
    return pa.RecordBatch.from_pydict(columns)


class _Split:
    """Leaves out errors whose figure adds up on the same line in another column of their page; those of a page that goes on wait."""

    def __init__(self):
        self.good, self.held, self.page = set(), [], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        for keys, batch in self.held:
            yield batch.filter(pa.array([k not in self.good for k in keys], pa.bool_()))
        self.held = []

    def passed(self, batch: pa.RecordBatch, found: _Found, page: int) -> Iterator[pa.RecordBatch]:
        """page is the one that goes on."""
        known = pc.and_(pc.is_valid(batch["doc_id"]), pc.is_valid(batch["page_index"]))
        lines = pc.if_else(known, pc.round(batch["top"], round_mode="half_to_even"), None).to_pylist()
        figures = batch["stated"].to_pylist()
        keys = [None if y is None else (p, "nan" if y != y else y, "nan" if v != v else v) for p, y, v in zip(found.pages, lines, figures)]
        wrong = [s == _ERROR for s in found.statuses]
        self.good |= {key for key, s, kind in zip(keys, found.statuses, found.kinds) if key and s == _OK and kind == _TOTAL}
        if page != self.page:
            yield from self.rest()
        waits = [bad and p == page for bad, p in zip(wrong, found.pages)]
        if any(waits):
            self.held.append(([k for k, w in zip(keys, waits) if w], batch.filter(pa.array(waits))))
        yield batch.filter(pa.array([not w and not (bad and key in self.good) for w, bad, key in zip(waits, wrong, keys)], pa.bool_()))
        if page != self.page:
            self.good, self.page = {key for key in self.good if key[0] == page}, page


def _folded(base: float, split: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, filtered = _Fold(base), _Split()
        for batch in batches:
            if not batch.num_rows:
                continue
            found, kept = fold.checks(batch)
            checks = _table(batch, found, kept)
            yield from [checks] if split else filtered.passed(checks, found, fold.page)
        yield from filtered.rest()

    return run


def column_checks(cells: DataFrame, base_tolerance: float = 1.0, split: bool = True) -> DataFrame:
    """Every total checked, over cells (doc_id, page_index, column, row_no, label, value, x0, top).

    Rows: the key of the column, row_no, label, kind (total, implicit), status (ok, error, unverified), stated, expected, x0,
    top, components. Cells without a value count for nothing. Without split the result is that of without_split_columns().
    """
    rows = cells.where("value is not null").select(
        "doc_id", *(F.col(c).cast("int").alias(c) for c in ("page_index", "column", "row_no")), F.coalesce("label", F.lit("")).alias("label"), *(F.col(c).cast("double").alias(c) for c in ("value", "x0", "top")),
        F.when(num.is_total(F.col("label")), _IS_TOTAL).when(num.is_derived(F.col("label")), _DERIVED).otherwise(_PLAIN).alias("is_a"),
    )
    # the numbering brings a page to one task, in order
    page = W.partitionBy("doc_id", "page_index").orderBy("column", "row_no", "label", "value", "x0", "top")
    rows = rows.withColumn("place", F.row_number().over(page))
    return rows.mapInArrow(_folded(base_tolerance, split), f"doc_id {dict(rows.dtypes)['doc_id']}, page_index int, column int, {_CHECK}")


def without_split_columns(checks: DataFrame) -> DataFrame:
    """checks without errors whose figure adds up on the same line in another column of the page, where a column was split."""
    key = ["doc_id", "page_index", "_line", "stated"]
    lined = checks.withColumn("_line", F.rint("top"))
    good = lined.where("kind = 'total' and status = 'ok'").select(*key).distinct()
    bad = lined.where("status = 'error'").join(good, key, "left_anti")
    return lined.where("status <> 'error'").unionByName(bad).drop("_line")


def analyze(cells: DataFrame, base_tolerance: float = 1.0) -> DataFrame:
    return column_checks(cells, base_tolerance, split=False).withColumn("difference", F.col("stated") - F.col("expected")).withColumn("message", message())


def message() -> F.Column:
    """What a reader is told about a check."""
    parts = F.array_join(F.transform("components", lambda c: F.concat(F.coalesce(F.nullif(F.substring(F.trim(c["label"]), 1, 24), F.lit("")), F.lit("?")), F.lit(" ("), num.format_number(c["value"]), F.lit(")"))), " + ")
    stated, expected, off = num.format_number(F.col("stated")), num.format_number(F.col("expected")), num.format_number(F.col("stated") - F.col("expected"))
    return (
        F.when(F.col("status") == "ok", F.concat(F.lit("Adds up: "), stated, F.lit(" = "), parts))
        .when(F.col("status") == "unverified", F.concat(F.lit("Total "), stated, F.lit(": its items could not be told apart")))
        .otherwise(F.concat(F.lit("Does not add up: stated "), stated, F.lit(", items give "), expected, F.lit(" (off by "), off, F.lit("). Items: "), parts))
    )


def report(checks: DataFrame) -> DataFrame:
    """One row a document: totals checked, figures added up, unverified totals, errors, and whether it is consistent."""
    return checks.groupBy("doc_id").agg(
        F.count("*").alias("totals_checked"),
        F.sum(F.size("components")).alias("figures_checked"),
        F.count_if(F.col("status") == "unverified").alias("unverified"),
        F.count_if(F.col("status") == "error").alias("errors"),
    ).withColumn("consistent", F.col("errors") == 0)


PRIORITY = {"component": 0, "ok": 1, "unverified": 2, "error": 3}


def annotations(checks: DataFrame, components: bool = True) -> DataFrame:
    """One mark for each figure (doc_id, page_index, x, y): the most important of those it gets, the first of equals.

    note is what a reader is told at a total that is wrong or unverified (where checks have a message), outlined whether a box is
    drawn around it, which errors have. Without components only totals are marked.
    """
    told = F.col("message") if "message" in checks.columns else F.lit(None).cast("string")
    own = checks.select("doc_id", "page_index", "column", "row_no", F.col("x0"), F.col("top"), F.col("status").alias("mark"), F.when(F.col("status").isin("error", "unverified"), told).alias("note"))
    marks = own
    if components:
        parts = checks.select("doc_id", "page_index", "column", "row_no", F.explode("components").alias("c"))
        marks = own.unionByName(parts.select("doc_id", "page_index", "column", "row_no", "c.x0", "c.top", F.lit("component").alias("mark"), F.lit(None).cast("string").alias("note")))
    rank = F.create_map(*(x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))))
    marks = marks.withColumn("x", F.rint("x0")).withColumn("y", F.rint("top"))
    first = F.struct(rank[F.col("mark")], -F.col("column"), -F.col("row_no"))
    best = marks.groupBy("doc_id", "page_index", "x", "y").agg(F.max_by(F.struct("mark", "note"), first).alias("m"))
    return best.select("doc_id", "page_index", "x", "y", "m.mark", "m.note", (F.col("m.mark") == "error").alias("outlined"))


def summary_rows(checks: DataFrame) -> DataFrame:
    """(doc_id, line, text): the lines of a document's summary: what was checked, how it came out, then each error with its page."""
    counts = checks.groupBy("doc_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "error", "unverified")), F.sum(F.size("components")).alias("figures"))
    heads = counts.select(
        "doc_id",
        F.posexplode(
            F.array(
                F.format_string("Checked %d totals covering %d figures.", F.col("ok") + F.col("error"), F.col("figures")),
                F.format_string("%d do not add up, %d add up, %d could not be verified.", "error", "ok", "unverified"),
            )
        ).alias("line", "text"),
    )
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("page_index", "column", "row_no"))
    wrong = checks.where("status = 'error'").withColumn("n", n)
    where = F.concat(F.col("n").cast("string"), F.lit(". Page "), (F.col("page_index") + 1).cast("string"), F.lit(": "), F.substring(F.trim("label"), 1, 60))
    stated, expected, off = num.format_number(F.col("stated")), num.format_number(F.col("expected")), num.format_number(F.col("stated") - F.col("expected"))
    text = F.concat(where, F.lit(" - stated "), stated, F.lit(", sum of figures "), expected, F.lit(" (off by "), off, F.lit(")"))
    return heads.unionByName(wrong.select("doc_id", (F.col("n") + 1).alias("line"), text.alias("text")))


def reconcile_static(items: DataFrame, keys: list[str], order: str, base: float = 0.0) -> DataFrame:
    """(keys, depth, total): for items with amount and a target per key, the shortest end that adds up to it, by window functions."""
    back = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    rows = items.withColumn("running", F.sum("amount").over(back)).withColumn("depth", F.count("*").over(back)).where(F.col("depth") <= LOOK_BACK)
    near = rows.where(F.abs(F.col("running") - F.col("target")) <= base)
    return near.groupBy(*keys).agg(F.min("depth").alias("depth"), F.min_by("running", "depth").alias("total"))
