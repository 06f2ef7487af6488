"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each direction is a GRU; every position gets a distribution over the languages from both states, and a document's
distribution is the mean over its positions. Training is backpropagation through time over segments of the sample.
Whole texts are scored, in segments of ``SEGMENT`` bytes side by side, each direction starting its segment afresh.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.llm.common import flat, fold, pieces, table

#: Bound of the training sample for each language, by the order of a hash of doc_id; and of a training text in bytes,
#: drawn from all of it in pieces of PIECE by a hash.
PER_LANGUAGE, TRAIN_BYTES, PIECE = 400, 1024, 64
HIDDEN = 6
SEGMENT = 128
#: Segments scored at once.
BATCH = 512
PAD = 256


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: tanh's part here, at a tenth of its time; its slope is (1 - |value|)^2."""
    return np.divide(x, 1 + np.abs(x), out=x)


class BiGRU:
    """Two GRUs (axis 0: forward, backward) with shared shapes; ``table`` holds the input's part of all gates by byte."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 9):
        r = np.random.default_rng(seed)
        self.h, self.k = hidden, classes
        self.p = {
            "table": r.normal(0, 0.5, (2, PAD + 1, 3 * hidden)).astype(np.float32),
            "uzr": r.normal(0, 0.3, (2, hidden, 2 * hidden)).astype(np.float32),
            "un": r.normal(0, 0.3, (2, hidden, hidden)).astype(np.float32),
            "out": r.normal(0, 0.3, (2, hidden, classes)).astype(np.float32),
            "bias": np.zeros(classes, np.float32),
        }

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (2, time, batch, hidden) for bytes x (time, batch)."""
        t, b = x.shape
        h = np.zeros((2, b, self.h), np.float32)
        out = np.empty((2, t, b, self.h), np.float32)
        n = self.h
        for i in range(t):
            a = np.stack([self.p["table"][0][x[i]], self.p["table"][1][x[t - 1 - i]]])
            s = _squash(a[:, :, : 2 * n] + np.matmul(h, self.p["uzr"]))
            zr = (1 + s) / 2
            z, r = zr[:, :, :n], zr[:, :, n:]
            rh = r * h
            c = _squash(a[:, :, 2 * n :] + np.matmul(rh, self.p["un"]))
            if keep is not None:
                keep.append((h, z, r, rh, c))
            h = h + z * (c - h)
            out[0, i], out[1, t - 1 - i] = h[0], h[1]
        return out

    def logits(self, states: np.ndarray) -> np.ndarray:
        return states[0] @ self.p["out"][0] + states[1] @ self.p["out"][1] + self.p["bias"]

    def train(self, segments: np.ndarray, labels: np.ndarray, steps: int = 250, batch: int = 256, seed: int = 9, rate: float = 0.03) -> None:
        """segments (count, time) of bytes, PAD after the end; the loss is taken at every position that has a byte."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            own = r.integers(0, len(segments), batch)
            grads = self._gradients(segments[own].T, labels[own])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            speed = rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        t, b = x.shape
        n, p = self.h, self.p
        kept: list = []
        states = self.states(x, kept)
        logits = self.logits(states)
        e = np.exp(logits - logits.max(-1, keepdims=True))
        d = e / e.sum(-1, keepdims=True)
        d[:, np.arange(b), y] -= 1
        real = (x != PAD).astype(np.float32)
        d *= (real / max(1.0, real.sum()))[:, :, None]
        g = {k: np.zeros_like(w) for k, w in p.items()}
        g["bias"] = d.sum((0, 1))
        flat_d = d.reshape(-1, self.k)
        for side in (0, 1):
            g["out"][side] = states[side].reshape(-1, n).T @ flat_d
        into = np.stack([d @ p["out"][0].T, (d @ p["out"][1].T)[::-1]])
        dh = np.zeros((2, b, n), np.float32)
        uzr_t, un_t = p["uzr"].transpose(0, 2, 1), p["un"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            h, z, r, rh, c = kept[i]
            dh = dh + into[:, i]
            # a gate is (1 + s) / 2, so its slope (1 - |s|)^2 / 2 is 2 * min(gate, 1 - gate)^2
            dc = dh * z * (1 - np.abs(c)) ** 2
            dz = dh * (c - h) * 2 * np.minimum(z, 1 - z) ** 2
            drh = np.matmul(dc, un_t)
            dr = drh * h * 2 * np.minimum(r, 1 - r) ** 2
            dzr = np.concatenate([dz, dr], -1)
            g["un"] += np.matmul(rh.transpose(0, 2, 1), dc)
            g["uzr"] += np.matmul(h.transpose(0, 2, 1), dzr)
            da = np.concatenate([dzr, dc], -1)
            np.add.at(g["table"][0], x[i], da[0])
            np.add.at(g["table"][1], x[t - 1 - i], da[1])
            dh = dh * (1 - z) + drh * r + np.matmul(dzr, uzr_t)
        return g

    def fast_states(self, x: np.ndarray) -> np.ndarray:
        """states() without a record for training, as (2, time, hidden, batch); buffers are used again at each step.

        The backward state is zero up to the last byte before the padding, so that a text's states do not depend on its batch.
        """
        t, b = x.shape
        n = self.h
        tables = np.ascontiguousarray(self.p["table"].transpose(0, 2, 1))
        uzr, un = (np.ascontiguousarray(self.p[k].transpose(0, 2, 1)) for k in ("uzr", "un"))
        at = x.astype(np.intp)
        real = (x != PAD).astype(np.float32)
        padded = (x == PAD).any(1)
        gates, zr, c, room = (np.empty((2, k * n, b), np.float32) for k in (3, 2, 1, 2))
        h, out = np.zeros((2, n, b), np.float32), np.empty((2, t, n, b), np.float32)
        for i in range(t):
            np.take(tables[0], at[i], axis=1, out=gates[0], mode="clip")
            np.take(tables[1], at[t - 1 - i], axis=1, out=gates[1], mode="clip")
            np.matmul(uzr, h, out=zr)
            zr += gates[:, : 2 * n]
            np.abs(zr, out=room)
            room += 1
            zr /= room
            zr += 1
            zr *= 0.5
            np.multiply(zr[:, n:], h, out=room[:, :n])
            np.matmul(un, room[:, :n], out=c)
            c += gates[:, 2 * n :]
            np.abs(c, out=room[:, :n])
            room[:, :n] += 1
            c /= room[:, :n]
            c -= h
            c *= zr[:, :n]
            h += c
            if padded[t - 1 - i]:
                h[1] *= real[t - 1 - i]
            out[0, i], out[1, t - 1 - i] = h
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Distribution over the classes at every position: (time, classes, batch)."""
        states = self.fast_states(x)
        z = np.matmul(self.p["out"][0].T, states[0])
        z += np.matmul(self.p["out"][1].T, states[1])
        z += self.p["bias"][:, None]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z


def _segments(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of each document in rows of ``size``, padded; each row's document, and how many bytes it has."""
    n = np.diff(ends)
    rows = -(-n // size)
    doc = np.repeat(np.arange(len(n)), rows)
    first = np.concatenate([[0], rows.cumsum()[:-1]])
    start = ends[:-1][doc] + (np.arange(len(doc)) - first[doc]) * size
    long = np.minimum(size, ends[1:][doc] - start)
    at = start[:, None] + np.arange(size)
    known = data.astype(np.int16)[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.zeros(at.shape, np.int16)
    out = np.where(np.arange(size) < long[:, None], known, np.int16(PAD))
    return out, doc, long


def pooled(net: BiGRU, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distribution over the classes for each document: the mean of those of all its positions."""
    count = len(ends) - 1
    rows, doc, long = _segments(data, ends, SEGMENT)
    total = np.zeros((count, net.k))
    order = np.argsort(-long, kind="stable")  # rows of like length share a batch, so short tails cost little
    for at in range(0, len(order), BATCH):
        own = order[at : at + BATCH]
        t = int(long[own].max())
        x = np.ascontiguousarray(rows[own, :t].T)
        p = net.positions(x)
        p *= (np.arange(t)[:, None] < long[own])[:, None, :]
        np.add.at(total, doc[own], p.sum(0).T)
    return total / np.maximum(1, np.diff(ends))[:, None]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[BiGRU | None, list[str]]:
    """A network from docs (doc_id, text, lang) with a language and letters outside fold 0, and its languages."""
    known = docs.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    names = list(counts)
    if not names:
        return None, []
    # a language's share by the order of a hash, with a margin; what is above the bound is cut here
    steps = 1_000_000
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(int(steps * min(1.0, 1.3 * per_language / n)) + 1))))
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(steps))
    some = known.withColumn("place", place).where(F.col("place") < share[F.col("lang")])
    whole = F.encode("text", "utf-8")
    order = F.sort_array(F.transform(F.sequence(F.lit(0), F.ceil(F.octet_length("text") / PIECE).cast("int") - 1), lambda i: F.struct(F.xxhash64("doc_id", i).alias("h"), i.alias("i"))))
    # in their order, so that a short last piece stays last
    drawn = F.sort_array(F.transform(F.slice(order, 1, TRAIN_BYTES // PIECE), lambda x: x["i"]))
    drawn = F.transform(drawn, lambda i: F.substring(whole, i * PIECE + 1, F.lit(PIECE)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "pieces"))
    rows = some.select("lang", "place", drawn.alias("pieces")).where("pieces is not null").withColumn("first", first).where(F.col("first") <= per_language).collect()
    rows.sort(key=lambda r: (r["place"], r["lang"], r["first"]))
    texts = pa.array([b"".join(r["pieces"]) for r in rows], pa.binary())
    data, ends = flat(texts)
    x, doc, long = _segments(data, ends, PIECE)
    own = (long >= 16) | (np.diff(ends)[doc] < 16)  # a short tail is left out, a short text is not
    y = np.array([names.index(r["lang"]) for r in rows])[doc[own]]
    x = x[own]
    # languages count alike
    r = np.random.default_rng(9)
    most = int(np.bincount(y).max())
    pick = np.concatenate([r.choice(np.flatnonzero(y == k), most) for k in range(len(names)) if (y == k).any()])
    net = BiGRU(len(names))
    net.train(x[pick], y[pick], steps=max(250, 16 * len(names)))
    return net, names


def language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang).

    Trained on at most per_language documents of each language outside fold 0 (TRAIN_BYTES bytes of each, in pieces from all of it); scored on whole
    texts. lang_pred is ``und`` and score 0 for a null text, one without a letter, and where no language is known. Other
    columns are left out.
    """
    net, names = train(docs, per_language)
    kind = dict(docs.dtypes)["doc_id"]

    def score(batches):
        for batch in pieces(batches, "text"):
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            pred, best = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            own = np.flatnonzero(lettered)
            if net is not None and len(own):
                p = pooled(net, *flat(batch.column("text").take(pa.array(own))))
                pred[own] = np.array(names, object)[p.argmax(1)]
                best[own] = p.max(1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(best)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("lettered", F.col("text").rlike(r"\p{L}"))
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))


QUERIES = {"op9_language": op9_language}
