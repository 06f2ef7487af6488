"""Document quality by co-training a text view and a metadata view.

The text view sees the text alone: letter shapes (hashed byte 3-grams in which letters, capitals and digits are each one symbol,
so it reads style rather than vocabulary) and layout figures. The metadata view never sees the text: source, language, the
length that the table gives, and how many documents share source, language and both, joined from counts over the whole table.
Each is a logistic regression in numpy. In each round a view labels the unlabelled documents it is surest of and hands them to
the other view. Platt scaling on documents that neither view trained on calibrates both. The views are taken as independent
given the label, so their log-odds are added and the prior's, which both hold, is taken off once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.llm.common import flat, fold, hinted, joined, pieces, table

#: Bounds of the samples, taken by the order of a hash of doc_id.
LABELLED, POOL = 6000, 6000
ROUNDS = 4
#: Confident pseudo-labels that a view hands over in a round, good and bad by their shares.
HANDED = 300
SHAPES = 256
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_LAYOUT = 11
_HASHED, _LENGTHS = 32, 16
#: Numbers of the metadata that come with a document; lengths are a number and a bin.
_COUNTED = ["n_chars", "of_source", "of_lang", "of_both"]
META = len(_COUNTED) + _LENGTHS + 2 * _HASHED
#: Rows up to which the counts of sources and languages are broadcast.
_COUNT_ROWS = 50_000


def text_view(text: pa.Array) -> np.ndarray:
    """Shapes and layout of texts, one row of floats each."""
    data, ends = flat(text)
    n = len(text)
    size = np.diff(ends)
    shape = _CLASS[data]
    doc = np.repeat(np.arange(n), size)
    grams = np.zeros((n, SHAPES))
    if len(data) > 2:
        own = doc[2:] == doc[:-2]
        gram = ((shape[:-2] * 961 + shape[1:-1] * 31 + shape[2:]) * 2654435761 >> 8) % SHAPES
        grams = np.bincount((doc[2:] * SHAPES + gram)[own], minlength=n * SHAPES).reshape(n, SHAPES).astype(float)
        grams = np.sqrt(grams / np.maximum(1, grams.sum(1, keepdims=True)))
    count = lambda mask: np.bincount(doc[mask], minlength=n)
    whole = np.maximum(1, size)
    lines = count(data == 10) + 1
    words = count(data == 32) + lines
    layout = np.zeros((n, _LAYOUT))
    share = [count(shape == ord("A")) / whole, count(shape == ord("0")) / whole, count((shape != ord("a")) & (shape != ord("A")) & (shape != ord("0")) & (data != 32) & (data != 10)) / whole, count(data == ord("|")) / whole]
    spaced = np.flatnonzero((data[1:] == 32) | (data[1:] == 10)) if len(data) else np.zeros(0, np.int64)
    twice = np.zeros(n)
    if len(spaced) > 2:
        # a word as its length and first bytes, against the word before it
        first = data[np.minimum(spaced + 2, len(data) - 1)].astype(np.int64) * 65536 + np.append(np.diff(spaced), 0) * 256 + data[np.minimum(spaced + 3, len(data) - 1)]
        twice = np.bincount(doc[spaced[1:]][first[1:] == first[:-1]], minlength=n) / np.maximum(1, words)
    layout[:, :9] = np.column_stack([np.log1p(size), np.log(lines), np.log1p(size / lines), np.log1p(words / lines), size / words / 10, *share[:3], twice])
    layout[:, 9] = share[3]
    layout[:, 10] = size == 0
    return np.concatenate([grams, layout], 1)


def meta_view(batch: pa.RecordBatch) -> np.ndarray:
    """What is known of documents beside their text: rows (source, lang, n_chars, of_source, of_lang, of_both)."""
    n = batch.num_rows
    out = np.zeros((n, META))
    numbers = np.log1p(np.column_stack([np.maximum(0, batch.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in _COUNTED])) if n else np.zeros((0, len(_COUNTED)))
    out[:, : len(_COUNTED)] = numbers
    at = len(_COUNTED)
    out[np.arange(n), at + np.minimum(_LENGTHS - 1, numbers[:, 0]).astype(int)] = 0.3
    at += _LENGTHS
    for name in ("source", "lang"):
        slot = [sum(b * 31**i for i, b in enumerate(v.encode())) % _HASHED for v in batch.column(name).to_pylist()]
        out[np.arange(n), at + np.array(slot, int)] = 0.3
        at += _HASHED
    return out


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text view and metadata view of a batch, neither of which sees what the other sees."""
    return text_view(batch.column("text")), meta_view(batch)


def fit(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Logistic regression by Adam on standardised columns: weights, bias, means, scales."""
    mean, scale = x.mean(0), x.std(0) + 1e-2
    z = (x - mean) / scale
    w, b = np.zeros(z.shape[1] + 1), 0.0
    z = np.column_stack([z, np.ones(len(z))])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    b = w[-1]
    return w[:-1], float(b), mean, scale


def logit(model, x: np.ndarray) -> np.ndarray:
    w, b, mean, scale = model
    return (x - mean) / scale @ w + b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of calibrated log-odds; the slope stays positive."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    w, b, mean, scale = fit(z[:, None], y, decay=1e-4, steps=400)
    a = max(1e-3, float(w[0] / scale[0]))
    return a, float(b - a * mean[0])


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, held: np.ndarray, rounds: int = ROUNDS, handed: int = HANDED):
    """Both views' models and calibrations, and the prior's log-odds, from labelled rows (held: those kept for calibration) and a pool without labels."""
    learn = ~held
    sets = [(text[learn], y[learn]), (meta[learn], y[learn])]
    pool = [pool_text, pool_meta]
    free = np.ones(len(pool_text), bool)
    share = float(np.clip(y[learn].mean(), 0.02, 0.98))
    models = [fit(*s) for s in sets]
    for _ in range(rounds):
        if free.sum() < handed:
            break
        for own, other in ((0, 1), (1, 0)):
            z = np.where(free, logit(models[own], pool[own]), np.nan)
            order = np.argsort(np.nan_to_num(z, nan=0.0))
            order = order[free[order]]
            good, bad = order[-round(handed * share) :], order[: handed - round(handed * share)]
            good, bad = good[z[good] > 2], bad[z[bad] < -2]
            given = np.concatenate([good, bad])
            if len(given):
                x, labels = sets[other]
                sets[other] = np.concatenate([x, pool[other][given]]), np.concatenate([labels, np.repeat([1.0, 0.0], [len(good), len(bad)])])
                free[given] = False
        models = [fit(*s) for s in sets]
    cal = [platt(logit(m, x[held]), y[held]) for m, x in zip(models, (text, meta), strict=True)]
    prior = float(np.clip(y[held].mean() if held.any() else share, 0.02, 0.98))
    return models, cal, float(np.log(prior / (1 - prior)))


def combined(models, cal, prior: float, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    z = [a * logit(m, x) + b for m, (a, b), x in zip(models, cal, (text, meta), strict=True)]
    return 1 / (1 + np.exp(-np.clip(z[0] + z[1] - prior, -500, 500)))


def _vectors(batches):
    for batch in pieces(batches, "text"):
        text, meta = views(batch)
        pack = lambda x: pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("held"), pack(text), pack(meta)], ["y", "held", "a", "b"])


def _sample(docs: DataFrame, ids: DataFrame, bound: int) -> tuple[np.ndarray, ...]:
    some = ids.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(bound)
    rows = docs.join(F.broadcast(some), "doc_id").select("text", "source", "lang", *_COUNTED, "y", "held").mapInArrow(_vectors, "y double, held boolean, a binary, b binary").collect()
    stack = lambda k, d: np.array([np.frombuffer(r[k], "<f4") for r in rows], float).reshape(len(rows), d)
    return stack("a", SHAPES + _LAYOUT), stack("b", META), np.array([r["y"] for r in rows], float), np.array([r["held"] for r in rows], bool)


def described(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, text, source, lang, n_chars, of_source, of_lang, of_both); the last three count documents of the whole table."""
    has = lambda c: F.col(c) if c in docs.columns else F.lit(None)
    named = [F.coalesce(has(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")]
    own = docs.select("doc_id", "text", *named, F.coalesce(has("n_chars").cast("long"), F.char_length("text").cast("long"), F.lit(0)).alias("n_chars"))
    both = own.groupBy("source", "lang").agg(F.count("*").alias("of_both"))
    for c in ("source", "lang"):
        both = both.withColumn(f"of_{c}", F.sum("of_both").over(W.partitionBy(c)))
    return joined(own, hinted(both, _COUNT_ROWS), ["source", "lang"], "left").select(*own.columns, "of_source", "of_lang", "of_both")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text; source, lang and n_chars if there): probability of good, 1 from 0.5 on.

    Trained on at most LABELLED labelled and POOL other documents outside fold 0; fold 1 of the labelled ones calibrates. Null
    text, source and lang are empty, as are columns that are not there; rows that repeat a doc_id are scored each. Where labels are missing or of one kind, every score is that share, or 0.5 without
    labels. Other columns are left out.
    """
    own = described(docs)
    known = labels.where((fold() != 0) & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("y"), (fold() == 1).alias("held"))
    text, meta, y, held = _sample(own, known, LABELLED)
    plain = None
    if not len(y) or y[~held].size == 0 or y[~held].min() == y[~held].max():
        plain = float(y.mean()) if len(y) else 0.5
    else:
        free = own.where(fold() != 0).select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(0.0).alias("y"), F.lit(False).alias("held"))
        pool_text, pool_meta, _, _ = _sample(own, free, POOL)
        model = co_train(text, meta, y, pool_text, pool_meta, held)

    def score(batches):
        for batch in pieces(batches, "text", 2_000_000):
            p = np.full(batch.num_rows, plain) if plain is not None else combined(*model, *views(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = own.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality": op10_quality}
