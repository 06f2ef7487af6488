"""Product codes of vectors, each part's nearest codebook entry found by Orchard search.

Vectors are cut into parts, and each part position has a codebook. Every entry keeps the list of all entries sorted by their
distance from it. A part's search stands at an entry and reads that entry's list: entries already visited are marked and
skipped, a nearer one (or an equally near one of lower index) becomes the place to stand, and its list is read from the start.
It ends where the list goes beyond twice the current distance: by the triangle inequality nothing there is as near. The search
goes on for all parts of a batch of rows at once. Distances are squared and whole, so the bound is exact: gap > 4 d.

Rounds of assignment send a sum and a count for each entry and task, added up by Spark; codebooks are the only thing that meets
on the driver, and their size does not follow the rows.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import hinted, joined, table, written
from barwise.llm.vectors import gathered, matrix, scaled, whole, widest

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Labels whose sums are broadcast; more of them are joined by a shuffle.
LABELS = 100_000


class Orchard:
    """Entries of one codebook with each one's list of all entries, nearest first."""

    def __init__(self, book: np.ndarray):
        self.book = book
        gaps = ((book[:, None] - book[None]) ** 2).sum(2)
        self.lists = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.lists, 1)
        # a search begins at the entry whose first component is next to the part's
        self.by_first = np.argsort(book[:, 0], kind="stable") if book.shape[1] else np.arange(len(book))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the entry of least squared distance, the lowest of equals, and that distance."""
        n, k = len(x), len(self.book)
        if not x.shape[1]:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = np.searchsorted(self.book[self.by_first, 0], x[:, 0]).clip(0, k - 1)
        best = self.by_first[place].astype(np.int64)
        d = ((x - self.book[best]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), best] = True
        at = np.zeros(n, np.int64)
        active = np.arange(n)
        while len(active):
            stand, j = best[active], at[active]
            near = self.gaps[stand, j] <= 4 * d[active]
            active, entry = active[near], self.lists[stand[near], j[near]]
            at[active] += 1
            fresh = ~seen[active, entry]
            row, entry = active[fresh], entry[fresh]
            seen[row, entry] = True
            new = ((x[row] - self.book[entry]) ** 2).sum(1)
            better = (new < d[row]) | ((new == d[row]) & (entry < best[row]))
            row = row[better]
            best[row], d[row], at[row] = entry[better], new[better], 0
            active = active[at[active] < k]
        return best, d


class Codebooks(NamedTuple):
    """Entries by part, entry and position; vectors are width components wide, the last part filled up with zeros."""

    entries: np.ndarray
    width: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def split(self, vectors: pa.Array) -> np.ndarray:
        parts, _, size = self.entries.shape
        return matrix(vectors, parts * size).reshape(len(vectors), parts, size)


def _sums(books: Codebooks):
    """For each part and entry the rows assigned in this task and the sums of their components."""

    def run(batches):
        parts, entries, size = books.entries.shape
        search = [Orchard(b) for b in books.entries]
        total, count = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in gathered(batches, parts * size):
            x = books.split(batch.column("v"))
            for p in range(parts):
                own = search[p].nearest(x[:, p])[0] + p * entries
                np.add.at(total, own, x[:, p])
                count += np.bincount(own, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["entry", "n", "sums"])

    return run


def _codes(books: Codebooks):
    def run(batches):
        parts, _, size = books.entries.shape
        search = [Orchard(b) for b in books.entries]
        for batch in gathered(batches, parts * size):
            x = books.split(batch.column("v"))
            found = [search[p].nearest(x[:, p]) for p in range(parts)]
            code = np.stack([f[0] for f in found], 1)
            error = np.sum([f[1] for f in found], 0).astype(np.int64)
            text = [row.tobytes().hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows of vectors (vec_id, embedding, perhaps label) that take part, components as floor(256 x)."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return whole(vectors).select("vec_id", label.alias("label"), scaled().alias("v"))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of rows (vec_id, v). They start as the rows of the least vec_ids (null comes last, the lesser vector first of
    equals); each round replaces an entry by the floor of the mean of its parts, an unused one stays."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256, as a code has two hex digits a part")
    width = widest(rows, "v")
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    size = -(-width // parts)
    books = np.zeros((parts, len(first), size), np.int64)
    for i, v in enumerate(first):
        books[:, i] = np.array([*v, *[0] * (parts * size - len(v))], np.int64).reshape(parts, size)
    for _ in range(rounds if first and size else 0):
        sums = rows.select("v").mapInArrow(_sums(Codebooks(books, width)), "entry long, n long, sums array<long>")
        added = F.array(*(F.sum(F.col("sums")[i]) for i in range(size)))
        for r in sums.groupBy("entry").agg(F.sum("n").alias("n"), added.alias("sums")).collect():
            books[divmod(r["entry"], len(first))] = np.array(r["sums"], np.int64) // r["n"]
    return Codebooks(books, width)


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of each of rows (vec_id, label, v)."""
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_codes(books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row of vectors (vec_id, embedding, label) with a whole vector.

    Vectors of unequal length are filled up with zeros to the longest, and that to a multiple of parts; an empty one is all
    zeros. With fewer rows than entries there are as many entries as rows. Rows that repeat a vec_id have a code each; null
    labels are one label. Other columns of vectors are left out.
    """
    rows = written(integers(vectors), "codes-vectors")
    books = train(rows, parts, entries, rounds)
    coded = written(encoded(rows, books), "codes-coded")
    by_label = hinted(coded.groupBy("label").agg(F.sum("error").alias("label_error")), LABELS)
    return joined(coded, by_label, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    def assigned(k: int) -> str:
        gap = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"a{k} AS (SELECT p.vec_id, p.part, any_value(p.x) AS x, min({gap} * 64 + b.entry)::BIGINT AS best FROM p JOIN b{k} b ON b.part = p.part GROUP BY p.vec_id, p.part)"

    def replaced(k: int) -> str:
        means = f"SELECT part, entry, place, floor(sum(c)::DOUBLE / count(*))::BIGINT AS c FROM (SELECT part, best % 64 AS entry, unnest(x) AS c, unnest(range(len(x))) AS place FROM a{k}) GROUP BY ALL"
        return f"b{k + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT part, entry, list(c ORDER BY place) AS x FROM ({means}) GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry)"

    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part::INT AS part, x[part * len(x) // 16 + 1 : (part + 1) * len(x) // 16] AS x FROM v, range(16) r(part)),
b0 AS (SELECT part, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1)::BIGINT AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{assigned(0)},
{replaced(0)},
{assigned(1)},
{replaced(1)},
{assigned(2)},
e AS (SELECT a.vec_id, label, string_agg(format('{{:02x}}', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 a JOIN v ON v.vec_id = a.vec_id GROUP BY a.vec_id, label),
s AS (SELECT sha256(string_agg(list_aggregate(x, 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, s"""


ORACLE = {"op13_codes": _oracle()}
QUERIES = {"op13_codes": op13_codes}
