"""Exact top-k search by inner product over a pivot-distance index.

Inner products become distances: a vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm, so all have norm
M, and a query q gets 0 there; then d(q, x)^2 = |q|^2 + M^2 - 2 q.x, and the highest score is the least distance.

*Index.* Every vector is keyed by its nearest pivot and its distance from it. Along each pivot's sorted distances annuli are cut,
by a histogram whose size has a bound, and each annulus is written in blocks of vectors packed together.

*Search.* A query expands its annuli in the order of their lower bounds. The first ones that hold enough vectors give its k-th
best score so far, at a distance r. Any annulus whose bound is beyond r holds nothing as good: by the triangle inequality
d(q, x) >= |d(q, p) - d(x, p)|, and as p is the nearest pivot of x, d(q, x) >= (d(q, p) - d(q, p')) / 2 for every other p'. The
others are scanned, blocks of queries against blocks of vectors, and only scores that reach the k-th so far leave a task. Scores
are whole numbers; bounds have a slack far above the error of floating point, so nothing is lost to rounding.

Where bounds exclude nothing, every query meets every block: that is the cost of an exact answer.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.llm.common import table, written
from barwise.llm.vectors import gathered, matrix, scaled, whole, widest

PIVOTS, SAMPLE = 64, 2_048
#: Bins of a pivot's distances, and annuli of all pivots: what comes to the driver and goes to all tasks holds so much at most.
BINS, ANNULI = 256, 16_384
#: Components in a block of vectors and in a block of queries.
BLOCK, ASKED = 1 << 16, 1 << 14


class Pivots(NamedTuple):
    """points with the added component, the greatest squared norm, and components of a vector without it."""

    points: np.ndarray
    greatest: int
    width: int

    @property
    def slack(self) -> float:
        return 1e-5 * (1 + np.sqrt(self.greatest))

    def lifted(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(0, self.greatest - (x * x).sum(1)).astype(float))
        return np.concatenate([x.astype(float), more[:, None]], 1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of lifted rows from each pivot."""
        square = (x * x).sum(1)[:, None] + (self.points**2).sum(1) - 2 * x @ self.points.T
        return np.sqrt(np.maximum(0, square))


class Annuli(NamedTuple):
    """By annulus: its pivot, its least and greatest distance, vectors in it."""

    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """For queries at distances d from the pivots: what no vector of an annulus is nearer than."""
        ring = np.maximum(self.low - d[:, self.pivot], d[:, self.pivot] - self.high)
        cell = (d - d.min(1, keepdims=True)) / 2
        return np.maximum(0, np.maximum(ring, cell[:, self.pivot]))


def _packed(x: np.ndarray) -> bytes:
    """A matrix of integers in the narrowest type that holds it, behind the bytes of that type."""
    most = int(np.abs(x).max()) if x.size else 0
    kind = np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(data: pa.Scalar, width: int, rows: int) -> np.ndarray:
    raw = np.frombuffer(data.as_buffer(), np.uint8)
    return raw[1:].view(f"i{raw[0]}").reshape(rows, width) if raw[0] == 1 else np.frombuffer(raw[1:].tobytes(), f"i{raw[0]}").reshape(rows, width)


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> Pivots:
    """Means of the groups of a sample (its bound is ``sample``): any points serve, those amid the vectors serve best."""
    width = widest(vectors, "v")
    greatest = int(vectors.agg(F.coalesce(F.max("norm"), F.lit(0))).first()[0])
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(sample).collect()
    empty = Pivots(np.zeros((1, width + 1)), greatest, width)
    if not drawn:
        return empty
    x = empty.lifted(np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in drawn], np.int64).reshape(len(drawn), width))
    points = np.unique(x, axis=0)
    points = points[np.linspace(0, len(points) - 1, min(pivots, len(points))).astype(int)]
    for _ in range(8):
        own = empty._replace(points=points).distances(x).argmin(1)
        points = np.stack([x[own == p].mean(0) if (own == p).any() else points[p] for p in range(len(points))])
    return empty._replace(points=points)


def _keys(p: Pivots):
    def run(batches):
        step = 2 * np.sqrt(p.greatest) / BINS + 1e-9
        for batch in gathered(batches, p.width):
            d = p.distances(p.lifted(matrix(batch.column("v"), p.width)))
            near = d.argmin(1)
            far = d[np.arange(len(near)), near]
            bins = (far / step).astype(np.int32).clip(0, BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(bins), pa.array(far)], ["vec_id", "v", "pivot", "bin", "d"])

    return run


def _blocks(width: int, asked: int):
    """Rows come sorted by annulus and part; each block holds up to ``asked`` vectors of one."""

    def run(batches):
        for batch in gathered(batches, width):
            x = matrix(batch.column("v"), width)
            at = batch.column("annulus").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            cuts = [c for a, b in zip(edge[:-1], edge[1:], strict=True) for c in range(a, b, asked)] + [len(at)]
            ids = batch.column("vec_id").to_numpy().astype("<i8")
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(at[a]) for a, _ in spans], pa.int32()), pa.array([b - a for a, b in spans], pa.int32()), pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([_packed(x[a:b]) for a, b in spans], pa.binary())],
                ["annulus", "n", "ids", "vectors"],
            )

    return run


class Index(NamedTuple):
    pivots: Pivots
    annuli: Annuli
    blocks: DataFrame


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, norm) of the rows of vectors (vec_id, embedding) that take part: whole vectors with an id, the least of a repeated id."""
    rows = whole(vectors.where("vec_id IS NOT NULL")).select("vec_id", scaled().alias("v"))
    rows = written(rows.withColumn("norm", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)), "topk-vectors")
    again = written(rows.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id"), "topk-repeated")
    if not again.limit(1).count():
        return rows
    one = rows.join(again, "vec_id").groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("least")).select("vec_id", "least.*")
    return written(rows.join(again, "vec_id", "left_anti").unionByName(one), "topk-vectors")


def indexed(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, annuli: int = ANNULI) -> Index:
    """The pivot-distance index of prepared() rows. The pivots come from a sample; every row is in the index."""
    p = choose_pivots(rows, pivots, sample)
    keyed = written(rows.select("vec_id", "v").mapInArrow(_keys(p), "vec_id long, v array<int>, pivot int, bin int, d double"), "topk-keys")
    bins = keyed.groupBy("pivot", "bin").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()
    bins.sort(key=lambda r: (r["pivot"], r["bin"]))
    held = max(1, block // max(1, p.width))
    least = max(held, sum(r["n"] for r in bins) // annuli)
    rings: list[list] = []
    names = []
    for r in bins:
        if not rings or rings[-1][0] != r["pivot"] or rings[-1][3] + r["n"] > least:
            rings.append([r["pivot"], r["low"], r["high"], 0])
        rings[-1][2] = r["high"]
        rings[-1][3] += r["n"]
        names.append((r["pivot"], r["bin"], len(rings) - 1, -(-r["n"] // (4 * least))))
    columns = zip(*rings, strict=True) if rings else [[], [], [], []]
    ring = Annuli(*(np.array(c, k) for c, k in zip(columns, (np.int64, float, float, np.int64), strict=True)))
    # PIVOTS * BINS rows at most; an annulus of very many equal distances is packed by several tasks
    named = keyed.sparkSession.createDataFrame(names, "pivot int, bin int, annulus int, parts int")
    dealt = keyed.join(F.broadcast(named), ["pivot", "bin"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
    dealt = dealt.repartition("annulus", "part").sortWithinPartitions("annulus", "part", "d").select("annulus", "vec_id", "v")
    blocks = written(dealt.mapInArrow(_blocks(p.width, held), "annulus int, n int, ids binary, vectors binary"), "topk-blocks")
    return Index(p, ring, blocks)


def _visits(index: tuple[Pivots, Annuli], k: int, asked: int, first: bool):
    """Which annuli each query visits: the first that hold over k vectors, or all others that its k-th score so far leaves open."""
    p, ring = index

    def run(batches):
        for batch in gathered(batches, p.width, asked * p.width):
            q = matrix(batch.column("v"), p.width)
            ids = batch.column("vec_id").to_numpy().astype("<i8")
            lifted = np.concatenate([q.astype(float), np.zeros((len(q), 1))], 1)
            bound = ring.bounds(p.distances(lifted))
            order = np.argsort(bound, axis=1, kind="stable")
            # the query itself may be among the first vectors, so one more than k
            before = np.cumsum(ring.size[order], 1) - ring.size[order] <= k
            opening = np.zeros_like(before)
            np.put_along_axis(opening, order, before, 1)
            if first:
                visit, reach = opening, np.full(len(q), np.iinfo(np.int64).min)
            else:
                some = batch.column("reach").is_valid().to_numpy(zero_copy_only=False)
                reach = batch.column("reach").fill_null(np.iinfo(np.int64).min).to_numpy()
                square = (q.astype(float) ** 2).sum(1) + p.greatest - 2 * reach.astype(float)
                r = np.where(some, np.sqrt(np.maximum(0, square)), np.inf)
                visit = (bound <= r[:, None] + p.slack) & ~opening
            rows = []
            for a in np.flatnonzero(visit.any(0)).tolist():
                own = np.flatnonzero(visit[:, a])
                for i in range(0, len(own), asked):
                    part = own[i : i + asked]
                    rows.append((a, len(part), ids[part].tobytes(), _packed(q[part]), reach[part].astype("<i8").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["annulus", "asked", "query_ids", "queries", "reach"])

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: by floating point where every sum stays below 2^53."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the smaller id first of equals."""
    if len(score) > 4 * k:
        own = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        own = np.arange(len(score))
    return own[np.lexsort((ids[own], -score[own]))[:k]]


def _scan(width: int, k: int):
    """Blocks of queries against blocks of vectors: of each block a query's k best that reach what it has."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for n, ids, vectors, asked, query_ids, queries, reach in zip(*(batch.column(c) for c in ("n", "ids", "vectors", "asked", "query_ids", "queries", "reach")), strict=True):
                x = _unpacked(vectors, width, n.as_py())
                q = _unpacked(queries, width, asked.as_py())
                own = np.frombuffer(ids.as_buffer(), "<i8")
                asking = np.frombuffer(query_ids.as_buffer(), "<i8")
                score = products(q, x)
                fits = (score >= np.frombuffer(reach.as_buffer(), "<i8")[:, None]) & (own != asking[:, None])
                for i in np.flatnonzero(fits.any(1)).tolist():
                    at = np.flatnonzero(fits[i])
                    at = at[best_of(score[i, at], own[at], k)]
                    out.append((np.full(len(at), asking[i]), own[at], score[i, at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def searched(index: Index, queries: DataFrame, k: int, asked: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of queries (vec_id, v) its k highest inner products in the index, its own row left out."""
    p, ring, blocks = index
    if not len(ring.size):
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    each = max(1, asked // max(1, p.width))

    def scanned(open_: DataFrame, first: bool) -> DataFrame:
        visits = open_.mapInArrow(_visits((p, ring), k, each, first), "annulus int, asked int, query_ids binary, queries binary, reach binary")
        met = written(visits, "topk-visits").join(blocks, "annulus").select("n", "ids", "vectors", "asked", "query_ids", "queries", "reach")
        return met.mapInArrow(_scan(p.width, k), "query_id long, vec_id long, score long")

    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    opening = written(ranked(scanned(queries.select("vec_id", "v"), True)), "topk-opening")
    reach = opening.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reach"))
    rest = scanned(queries.select("vec_id", "v").join(reach, "vec_id", "left"), False)
    return ranked(opening.drop("rank").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, every: int, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row whose vec_id ``every`` divides, among all other rows.

    vectors has (vec_id, embedding); components count as floor(256 x). Rows without a vec_id, a vector or a finite component take
    no part, nor does any but the least vector of a repeated vec_id. Shorter vectors end in zeros. Equal scores go to the smaller
    vec_id; with fewer than k other rows all are returned. Other columns are left out.
    """
    rows = prepared(vectors.withColumn("vec_id", F.col("vec_id").cast("long")))
    # near queries lie near each other, so that their blocks visit the same annuli
    index = indexed(rows, pivots, sample, block)
    asking = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    keyed = asking.mapInArrow(_keys(index.pivots), "vec_id long, v array<int>, pivot int, bin int, d double")
    return searched(index, written(keyed.repartition("pivot").sortWithinPartitions("pivot", "d").select("vec_id", "v"), "topk-queries"), k, asked)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


ORACLE = {
    "op12_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 5"""
}
QUERIES = {"op12_topk": op12_topk}
