"""Toxicity by non-negative positive-unlabelled learning (nnPU) over hashed words and word beginnings.

The classifier sees confirmed toxic documents (P) and unlabelled ones (U). With class prior p its risk is
``p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])``; while the second term is below zero its gradient is reversed, which
keeps a flexible model from fitting U as clean. Weights start at zero; the risk alone makes them. Features are whole words and their first 4, 5 and 6 bytes, kept where they
are much more frequent in P than in U; a document holds a feature or not, however often. cross_validated() chooses how
strict that is, from the rows that may be learned from alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import LOWER, U64, Rolling, flat, fold, mixed, pieces, table

#: Bounds of the training sample, taken by the order of a hash of doc_id.
POSITIVES, UNLABELLED = 4000, 8000
BUCKETS = 1 << 20
_ROLL = Rolling(81)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_SALT = {0: U64(0x1F3D5B79), 4: U64(0x2468ACE1), 5: U64(0x3579BDF1), 6: U64(0x468ACE02)}


class Settings(NamedTuple):
    """What a feature must show in P: its share of documents, its deviations beyond chance as a multiple of what the best of all features shows by chance, its lift as a power of 1 / prior; and Adam's steps over the whole sample."""

    support: float = 0.01
    deviations: float = 1.2
    lift: float = 0.9
    steps: int = 600


#: What cross_validated() looks at. The defaults of Settings are of the least risks on sf0.1, inside their sampling error.
GRID = [Settings(s, d, k, n) for s in (0.005, 0.01, 0.02) for d in (0.8, 1.0, 1.2, 1.4) for k in (0.6, 0.8, 0.9, 1.0) for n in (300, 600)]


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) for each word and word beginning of a flat buffer."""
    data = LOWER[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1]))
    stop = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    doc = np.searchsorted(ends, start, side="right") - 1
    sums = _ROLL.sums(data)
    docs, found = [], []
    for size, salt in _SALT.items():
        own = slice(None) if not size else stop - start > size
        a, b = start[own], stop[own] if not size else start[own] + size
        found.append((mixed(_ROLL.of(sums, a, b) + salt) % U64(BUCKETS)).astype(np.int64))
        docs.append(doc[own])
    return np.concatenate(docs), np.concatenate(found)


def _extract(batches):
    for batch in pieces(batches, "text"):
        doc, found = features(*flat(batch.column("text")))
        pairs = np.unique(doc * BUCKETS + found)
        cut = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * BUCKETS)
        own = (pairs % BUCKETS).astype("<i4")
        yield pa.RecordBatch.from_arrays([pa.array([own[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), batch.column("fold")], ["found", "fold"])


def scores(text: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    doc, found = features(*flat(text))
    own = weights[found] != 0
    pairs = np.unique(doc[own] * BUCKETS + found[own])
    total = np.bincount(pairs // BUCKETS, weights[pairs % BUCKETS], len(text)) + bias
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _distinct(sets: list[np.ndarray]) -> list[np.ndarray]:
    """One of each group of near copies in a training sample, by three minhashes; else their words pass for toxic ones."""
    kept: dict = {}
    for s in sets:
        x = s.astype(U64) + U64(1)
        kept.setdefault(tuple(int(mixed(x * m).min()) for m in (U64(3), U64(5), U64(7))) if len(x) else None, s)
    return list(kept.values())


def nnpu(p: list[np.ndarray], u: list[np.ndarray], prior: float, settings: Settings = Settings(), seed: int = 8) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias of a linear classifier from the feature sets of P and U."""
    weights = np.zeros(BUCKETS)
    if not p or not u or prior <= 0:
        return weights, -20.0
    p, u = _distinct(p), _distinct(u)
    in_p, in_u = (np.bincount(np.concatenate(x), minlength=BUCKETS) for x in (p, u))
    lift = np.log((in_p + 0.5) / (len(p) + 1)) - np.log((in_u + 0.5) / (len(u) + 1))
    # a feature of toxic documents alone has the lift 1 / prior
    # and it must be seen in P beyond chance; the best of m features is sqrt(2 log m) deviations above it by chance
    rate = (in_u + 0.5) / (len(u) + 1)
    chance, deviation = len(p) * rate, np.sqrt(len(p) * rate * (1 - rate))
    beyond = settings.deviations * np.sqrt(2 * np.log(max(2, np.count_nonzero(in_p + in_u))))
    good = np.flatnonzero((in_p >= max(4, settings.support * len(p))) & (in_p - chance > beyond * deviation) & (lift > settings.lift * np.log(1 / prior)))
    if not len(good):
        return weights, float(np.log(prior / (1 - prior)))
    place = np.full(BUCKETS, -1)
    place[good] = np.arange(len(good))

    def matrix(sets):
        out = np.zeros((len(sets), len(good)), np.float32)
        for i, s in enumerate(sets):
            at = place[s]
            out[i, at[at >= 0]] = 1
        return out

    xp, xu = matrix(p), matrix(u)
    w, b, _ = descend(xp, xu, prior, settings.steps)
    weights[good] = w
    return weights, b


def descend(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int, non_negative: bool = True) -> tuple[np.ndarray, float, int]:
    """Weights and bias from zero on by Adam over all rows of P and U, and how many steps reversed a negative risk.

    Logistic loss: l(g) = -log s(g), l(-g) = -log(1 - s(g)). Without non_negative the risk is the plain unbiased one.
    """
    xp, xu = (np.column_stack([x, np.ones(len(x), np.float32)]) for x in (xp, xu))
    w = np.zeros(xp.shape[1])
    m, v, reversed_ = np.zeros_like(w), np.zeros_like(w), 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))
    narrow = lambda z: z.astype(np.float32)
    for t in range(1, steps + 1):
        gp, gu = sigmoid(xp @ narrow(w)), sigmoid(xu @ narrow(w))
        negative = prior * np.log1p(-gp).mean() - np.log1p(-gu).mean()
        of_p, of_n = -prior * (xp.T @ narrow(1 - gp)) / len(xp), xu.T @ narrow(gu) / len(xu) - prior * (xp.T @ narrow(gp)) / len(xp)
        if non_negative and negative < 0:
            grad, reversed_ = -of_n, reversed_ + 1
        else:
            grad = of_p + of_n
        grad = grad.astype(float)
        grad[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1]), reversed_


def _sample(docs: DataFrame, ids: DataFrame, bound: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature sets of at most ``bound`` ids and the fold of each."""
    some = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", fold().alias("fold")).mapInArrow(_extract, "found binary, fold long").collect()
    return [np.frombuffer(r["found"], "<i4") for r in rows], np.array([r["fold"] for r in rows], np.int64)


def _training(docs: DataFrame, labels: DataFrame, prior: float | None, positives: int, unlabelled: int):
    learn = labels.where((fold() != 0) & F.col("toxic").isNotNull())
    if prior is None:
        prior = learn.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    p = _sample(docs, learn.where("toxic = 1"), positives)
    u = _sample(docs, docs.where(fold() != 0), unlabelled)
    return p, u, float(prior)


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """A classifier from docs (doc_id, text) and labels (doc_id, toxic), none of fold 0; prior: the share of toxic among labels if null."""
    (p, _), (u, _), prior = _training(docs, labels, prior, positives, unlabelled)
    return nnpu(p, u, prior)


def _called(sets: list[np.ndarray], weights: np.ndarray, bias: float) -> float:
    """Share of the feature sets that are called toxic."""
    return float(np.mean([weights[s].sum() + bias >= 0 for s in sets])) if sets else 0.0


def cross_validated(docs: DataFrame, labels: DataFrame, grid: list[Settings] | None = None, prior: float | None = None) -> list[tuple[float, Settings]]:
    """(risk, settings), least first: the positive-unlabelled zero-one risk over folds 1 to 4, each judged by a classifier of the other three.

    Neither texts nor labels of fold 0 are read. To choose the defaults of Settings, not a part of scoring. Settings with
    the same risk keep the order of the grid.
    """
    (p, p_fold), (u, u_fold), prior = _training(docs, labels, prior, POSITIVES, UNLABELLED)
    out = []
    for settings in grid or GRID:
        risks = []
        for k in range(1, 5):
            model = nnpu([s for s, f in zip(p, p_fold, strict=True) if f != k], [s for s, f in zip(u, u_fold, strict=True) if f != k], prior, settings)
            hit = _called([s for s, f in zip(p, p_fold, strict=True) if f == k], *model)
            risks.append(prior * (1 - hit) + max(0.0, _called([s for s, f in zip(u, u_fold, strict=True) if f == k], *model) - prior * hit))
        out.append((float(np.mean(risks)), settings))
    return sorted(out, key=lambda x: x[0])


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text): probability of toxic, 1 from 0.5 on.

    Trained on at most POSITIVES toxic and UNLABELLED other documents outside fold 0. A null or empty text has no feature
    and gets the score of such; a null doc_id is not held out. Without toxic labels nothing is predicted toxic. Other
    columns are left out.
    """
    weights, bias = train(docs, labels, prior)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "text")

    def run(batches):
        for batch in pieces(batches, "text"):
            score = pa.array(scores(batch.column("text"), weights, bias))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), score], ["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not call toxic, all columns."""
    weights, bias = train(docs, labels)

    def keep(batches):
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.array(scores(batch.column("text"), weights, bias) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
