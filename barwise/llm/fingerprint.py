"""Similarity digests of improbable features.

A feature is a window of ``WIDTH`` bytes. Its rarity is its information under a byte-pair model of the whole corpus: the sum
over the window of -log2 p(byte | byte before). A window that is the rarest of ``REACH`` consecutive ones at least
``POPULAR`` times is selected. Selected windows go into Bloom filters of 2048 bits, five bits each, 160 windows a filter, then
the next filter of the chain. Two digests are compared filter by filter: shared bits beyond those expected by chance, over the
most that could be shared; the likeness is the mean over the filters of the shorter chain of their best match.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import Rolling, U64, flat, mixed, pieces, sliding_min, table

WIDTH, REACH, POPULAR = 64, 64, 16
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Ranges of doc_id at most.
MAX_RANGES = 10_000
_ROLL = Rolling(71)
_POS = U64(0xFFFFFF)
#: Windows ranked at once; a place counts from the chunk's start and with its neighbourhood stays below _POS.
_CHUNK = 1 << 23


def _pairs(batches):
    """Counts of byte pairs inside documents, one row a partition and pair that occurs."""
    total = np.zeros(65536, np.int64)
    for batch in pieces(batches, "text"):
        data, ends = flat(batch.column("text"))
        pair = data[:-1].astype(np.int64) * 256 + data[1:]
        inside = np.ones(max(0, len(data) - 1), bool)
        cut = ends[1:-1] - 1
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
        total += np.bincount(pair[inside], minlength=65536)
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["pair", "n"])


def surprise(docs: DataFrame) -> np.ndarray:
    """Bits of information of each byte pair over all docs; at most 65,536 rows come to the driver."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    count = np.full(65536, 0.5)
    for r in rows:
        count[r["pair"]] += r["n"]
    grid = count.reshape(256, 256)
    return -np.log2(grid / grid.sum(1, keepdims=True)).ravel()


def _rarest(levels: np.ndarray) -> np.ndarray:
    """For each REACH windows in turn the place of the rarest, the first of equal ones."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(levels) - REACH + 1, _CHUNK):
        own = levels[at : at + _CHUNK + REACH - 1]
        keys = ((U64(2**40 - 1) - own) << U64(24)) | np.arange(len(own), dtype=U64)
        out.append((sliding_min(keys, REACH) & _POS).astype(np.int64) + at)
    return np.concatenate(out)


def _selected(data: np.ndarray, ends: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash) of the selected windows; a text shorter than a window is one feature, an empty one has none."""
    size = np.diff(ends)
    docs, found = [], []
    sums = _ROLL.sums(data)
    short = np.flatnonzero((size > 0) & (size < WIDTH + REACH))
    # a text with fewer windows than a neighbourhood: its one rarest window, or all of it
    if len(data) > WIDTH:
        # whole numbers, so that a window's sum does not depend on its place
        info = np.zeros(len(data) + 1, np.int64)
        np.cumsum((bits * 2**30).astype(np.int64)[np.concatenate([[0], data[:-1].astype(np.int64) * 256 + data[1:]])], out=info[1:])
        # the first byte of a window has no pair inside it
        levels = np.clip((info[WIDTH:] - info[1 : len(info) - WIDTH + 1]) >> 20, 0, 2**39).astype(U64)
    for i in short.tolist():
        a, b = int(ends[i]), int(ends[i + 1])
        at = a
        if b - a > WIDTH:
            at = a + int(levels[a : b - WIDTH + 1].argmax())
        docs.append(np.array([i]))
        found.append(_ROLL.of(sums, np.array([at]), np.array([min(b, at + WIDTH)])))
    if len(data) >= WIDTH + REACH:
        least = _rarest(levels)
        n = np.maximum(0, size - WIDTH - REACH + 2)
        n[size < WIDTH + REACH] = 0
        doc = np.repeat(np.arange(len(size)), n)
        start = np.arange(len(doc)) - np.concatenate([[0], n.cumsum()[:-1]])[doc] + ends[:-1][doc]
        if len(doc):
            at = least[start]
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            often = np.diff(np.concatenate([new, [len(at)]]))
            first = np.concatenate([[True], doc[new][1:] != doc[new][:-1]])
            take = new[(often >= POPULAR) | first]  # a document keeps one feature at least
            docs.append(doc[take])
            found.append(_ROLL.of(sums, at[take], at[take] + WIDTH))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return doc[order], mixed(np.concatenate(found)[order])


def digests(texts: list[bytes], bits: np.ndarray) -> list[np.ndarray]:
    """For each text its chain of filters, rows of BITS / 8 bytes; equal features count once."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    doc, found = _selected(data, ends, bits)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = found[a:b]
        own = own[np.sort(np.unique(own, return_index=True)[1])]
        chain = np.zeros((-(-len(own) // PER_FILTER), BITS), bool)
        row = np.arange(len(own)) // PER_FILTER
        for k in range(HASHES):
            chain[row, ((own >> U64(11 * k)) % U64(BITS)).astype(np.int64)] = True
        out.append(np.packbits(chain, axis=1))
    return out


_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; equal digests have 1, an empty one has nothing in common with a filled one."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    x, y = _ONES[a].sum(1), _ONES[b].sum(1)
    best = []
    for i in range(len(a)):
        shared = _ONES[a[i] & b].sum(1)
        most = np.minimum(x[i], y)
        chance = x[i] * y / BITS
        best.append(max(0.0, float(((shared - chance) / np.maximum(1e-9, most - chance)).max())))
    return float(min(1.0, np.mean(best)))


def text_of(chain: np.ndarray) -> str:
    return chain.tobytes().hex()


def fingerprints(docs: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint) for each row of docs (doc_id, text): the filters in hexadecimal, empty for a null or empty text.

    bits is the model of surprise(docs), made here if null. Equal texts have equal fingerprints under one model. Rows that
    repeat a doc_id have theirs each. Other columns are left out.
    """
    bits = surprise(docs) if bits is None else bits
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in pieces(batches, "text"):
            data, ends = flat(batch.column("text"))
            raw = data.tobytes()
            got = digests([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([text_of(c) for c in got])], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_next(docs: DataFrame, per_range: int = 4000) -> DataFrame:
    """Rows (part, ghost, doc_id, text) in which each document is followed, within its part, by the next one in descending doc_id.

    Parts are ranges of the integer doc_id, of about per_range documents, MAX_RANGES parts at most; rows stream through a part
    in order, so its size is no bound. The first document of the range below (of the highest range, for the lowest) stands at
    the end of each as a ghost, so no part looks into another. Only range bounds and first ids come to the driver, one a part.
    A null text is empty; null ids come last; of rows that repeat an id the order is that of a hash of their text.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    ids = own.select(F.col("doc_id").cast("double").alias("id"))
    parts = min(MAX_RANGES, max(1, ids.count() // per_range))
    bounds = sorted(set(ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    # found by bisection; ids too long for a double fall to the same side of a bound as their double
    ranged = Bucketizer(splits=[-math.inf, *(bounds or [0.0]), math.inf], inputCol="id", outputCol="range", handleInvalid="keep")
    own = ranged.transform(own.withColumn("id", F.col("doc_id").cast("double")))
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("range").cast("int"))
    placed = own.withColumn("part", part).drop("id", "range")
    firsts = {r["part"]: r["x"] for r in placed.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("x")).collect()}
    order = sorted(firsts)
    ghosts = [(firsts[p]["doc_id"], firsts[p]["tie"], order[(i + 1) % len(order)]) for i, p in enumerate(order)]
    named = docs.sparkSession.createDataFrame([(d, t, p) for d, t, p in ghosts], "g_id long, g_tie long, to_part int")
    lent = placed.join(F.broadcast(named), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie"))).dropDuplicates(["doc_id", "tie"])
    lent = lent.select(F.col("to_part").alias("part"), F.lit(True).alias("ghost"), "doc_id", "tie", "text")
    every = placed.select("part", F.lit(False).alias("ghost"), "doc_id", "tie", "text").unionByName(lent)
    dealt = every.repartition(max(1, len(order)), "part")
    return dealt.sortWithinPartitions("part", "ghost", F.desc("doc_id"), F.desc("tie")).select("part", "ghost", "doc_id", "text")


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return (text[:-n] if n else text) + following[:n]


def _compared(bits: np.ndarray):
    def run(batches):
        held: list[tuple] = []  # the last one's next is not known yet

        def flush(rows):
            at = [i for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)) if a[0] == b[0] and not a[1]]
            done = [rows[i] for i in at]
            changed = [edited(rows[i][3], rows[i + 1][3]).encode() for i in at]
            got = digests([r[3].encode() for r in rows] + changed, bits)
            own, nxt, other = [got[i] for i in at], [got[i + 1] for i in at], got[len(rows) :]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a in done], pa.int64()),
                    pa.array([len(a[3]) for a in done], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                    pa.array([text_of(c) for c in own], pa.string()),
                    pa.array([text_of(c) for c in other], pa.string()),
                    pa.array([likeness(x, y) for x, y in zip(own, other, strict=True)], pa.float64()),
                    pa.array([likeness(x, y) for x, y in zip(own, nxt, strict=True)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("part", "ghost", "doc_id", "text")), strict=True):
                held.append(row)
                size += len(row[3])
                if size > 700_000 and len(held) > 1:
                    yield flush(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield flush(held)

    return run


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_next(docs).mapInArrow(_compared(surprise(docs)), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


QUERIES = {"op7_fingerprint": op7_fingerprint}
