"""Removal of repeated byte strings by blockwise suffix sorting over a cover sample.

A 200-byte string is repeated if it starts at two places anywhere in the corpus. Sorting every suffix of the corpus would
move many times the input, so the sort works on a cover of it, in the manner of difference-cover construction:

1. *Cover sample.* Of the 48-byte substrings inside each 200-byte string, the one with the least hash (the leftmost of
   equals) is its sample. Equal strings choose the same shift, so any two of them meet in the sample at one distance,
   which is what a difference cover promises of two suffixes. About one position in 77 is sampled.
2. *Buckets.* The strings of one sample form a run of starts with one context (the bytes they span). Runs fall into suffix
   buckets by the hash of the sampled substring. A bucket with one run holds no repeat and is dropped; one where all
   contexts agree is repeated throughout. Only the others are sorted, each distinct context once.
3. *Blockwise sort.* Buckets are sorted a block at a time: samples by the bytes after them (their cover ranks) and by the
   bytes before them. Two strings at the same distance ``d`` from their samples are compared over ``d`` bytes only; the
   rest, however long the tie, is decided by the ranks of their samples and the common-prefix lengths beside them.
4. Buckets with more distinct contexts than a block holds (a passage copied into a large share of all documents) are
   settled by counting their strings one by one under a 128-bit key, combined before the shuffle.

Identity of contexts rests on 128 bits of hash; within sorted buckets the bytes themselves are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import Rolling, U64, dealt, flat, hot_keys, joined, mixed, pieces, signed, sliding_min, table, written

LENGTH = 200
GRAM = 48
#: Distinct contexts of one bucket that a block sorts; larger buckets are counted string by string.
BLOCK_CONTEXTS = 16_384
_POS = U64(0xFFFFFF)
_A, _B, _C = Rolling(11), Rolling(12), Rolling(13)
_CHUNK = 8_000_000


def _runs_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run of starts with one sample: document, sample, first and last start (in data), bucket and context hashes."""
    starts, stops = ends[:-1], ends[1:]
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(U64), none.view(U64)
    sums = _A.sums(data)
    grams = mixed(_A.every(sums, gram))
    keys = (grams & ~_POS) | np.arange(len(grams), dtype=U64)
    at = (sliding_min(keys, length - gram + 1) & _POS).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), np.maximum(0, stops - starts - length + 1))
    if not len(doc):
        return none, none, none, none, none.view(U64), none.view(U64)
    n = np.maximum(0, stops - starts - length + 1)
    first = np.concatenate([[0], n.cumsum()[:-1]])
    start = np.arange(len(doc)) - first[doc] + starts[doc]
    sample = at[start]
    new = np.flatnonzero(np.concatenate([[True], sample[1:] != sample[:-1]]))
    lo, hi, sample = start[new], start[np.concatenate([new[1:], [len(doc)]]) - 1], sample[new]
    other = _B.sums(data)
    context = mixed(_B.of(other, lo, hi + length) + mixed(((hi - lo) * 1024 + sample - lo).astype(U64)))
    return doc[new], sample, lo, hi, grams[sample], context


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """As _runs_of; a document of more than _CHUNK bytes goes through in overlapping pieces, whose strings are its strings."""
    if len(data) <= _CHUNK:
        return _runs_of(data, ends, length, gram)
    got = []
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        for at in range(int(a), int(b), _CHUNK):
            piece = data[at : min(int(b), at + _CHUNK + length - 1)]
            doc, sample, lo, hi, h, c = _runs_of(piece, np.array([0, len(piece)]), length, gram)
            got.append((doc + i, sample + at, lo + at, hi + at, h, c))
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _candidates(length: int, gram: int):
    def run(batches):
        for batch in pieces(batches, "text"):
            data, ends = flat(batch.column("text"))
            doc, _, _, _, h, c = runs(data, ends, length, gram)
            yield pa.RecordBatch.from_arrays([signed(h), signed(c), batch.column("doc_id").take(pa.array(doc))], ["h", "c", "doc_id"])

    return run


def _contexts(length: int, gram: int):
    """The bytes of the wanted contexts: rows (h, c, n, back, bytes), back being the sample's place in them."""

    def run(batches):
        for batch in pieces(batches, "text"):
            data, ends = flat(batch.column("text"))
            doc, sample, lo, hi, h, c = runs(data, ends, length, gram)
            wanted = [{(x["h"], x["c"]): x["n"] for x in row} for row in batch.column("wanted").to_pylist()]
            out = []
            for i, key in enumerate(zip(h.view(np.int64).tolist(), c.view(np.int64).tolist(), strict=True)):
                n = wanted[doc[i]].pop(key, None)
                if n is not None:
                    out.append((*key, n, int(sample[i] - lo[i]), data[lo[i] : hi[i] + length].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["h", "c", "n", "back", "bytes"])

    return run


def _sorted_block(h, c, n, back, texts, length: int, reach: int):
    """Mask of repeated strings by distance from the sample for the contexts of whole buckets."""
    m = len(texts)
    after = np.zeros((m, length + 8), np.uint8)
    before = np.zeros((m, reach + 8), np.uint8)
    after[:, :8] = before[:, :8] = h.astype(">i8").view(np.uint8).reshape(m, 8)
    size = np.array([len(x) for x in texts])
    for i, t in enumerate(texts):
        row = np.frombuffer(t, np.uint8)
        after[i, 8 : 8 + len(row) - back[i]] = row[back[i] :]
        before[i, 8 : 8 + back[i]] = row[: back[i]][::-1]
    far, near = back, length - (size - back)  # distances that the run's strings have: near..far

    def ranked(rows):
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
        got = rows[order]
        differ = got[1:] != got[:-1]
        shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1]) - 8
        return order, shared

    order_a, shared_a = ranked(after)
    order_b, shared_b = ranked(before)
    masks = np.zeros((m, reach + 1), bool)
    rank_a, rank_b = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(int(near.min()), int(far.max()) + 1):
        own = np.flatnonzero((near <= d) & (d <= far))
        if not len(own):
            continue
        rank_a[order_a] = np.concatenate([[0], np.cumsum(shared_a < length - d)])
        rank_b[order_b] = np.concatenate([[0], np.cumsum(shared_b < d)])
        key = rank_a[own] * m + rank_b[own]
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        total = np.add.reduceat(n[own][order], edge)
        masks[own[order], d] = np.repeat(total >= 2, np.diff(np.concatenate([edge, [len(order)]])))
    return masks


def _sort(length: int, gram: int):
    """Rows arrive sorted by bucket; whole buckets are gathered to a block and sorted."""
    reach = length - gram

    def flush(rows):
        h, c, n, back, texts = zip(*rows, strict=True)
        masks = _sorted_block(np.array(h), np.array(c), np.array(n), np.array(back), texts, length, reach)
        keep = masks.any(1)
        packed = np.packbits(masks[keep], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.array(h)[keep]), pa.array(np.array(c)[keep]), pa.array([x.tobytes() for x in packed], pa.binary())], ["h", "c", "mask"])

    def run(batches):
        rows, last = [], None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "n", "back", "bytes")), strict=True):
                if row[0] != last and len(rows) >= BLOCK_CONTEXTS:
                    yield flush(rows)
                    rows = []
                rows.append(row)
                last = row[0]
        if rows:
            yield flush(rows)

    return run


def _strings(length: int):
    """Each string of the contexts of a large bucket: its distance and a second hash, the bucket's hash being the first."""

    def run(batches):
        for batch in pieces(batches, "bytes", 200_000):
            data, ends = flat(batch.column("bytes"))
            count = np.diff(ends) - length + 1
            row = np.repeat(np.arange(len(count)), count)
            start = np.arange(len(row)) - np.concatenate([[0], count.cumsum()[:-1]])[row] + ends[row]
            value = mixed(_C.of(_C.sums(data), start, start + length))
            d = batch.column("back").to_numpy()[row] - (start - ends[row])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("h").take(take), batch.column("c").take(take), batch.column("n").take(take), pa.array(d.astype(np.int32)), signed(value)], ["h", "c", "n", "d", "s"])

    return run


def _removed(length: int, gram: int, keep_text: bool):
    reach = length - gram

    def run(batches):
        for batch in pieces(batches, "text"):
            data, ends = flat(batch.column("text"))
            found = batch.column("found").to_pylist()
            some = pa.array([i for i, x in enumerate(found) if x])
            by_doc: dict[int, list] = {}
            if len(some):
                part, part_ends = flat(batch.column("text").take(some))
                for doc, sample, lo, hi, h, c in zip(*(x.tolist() for x in runs(part, part_ends, length, gram)), strict=True):
                    by_doc.setdefault(some[doc].as_py(), []).append((sample - part_ends[doc], lo - part_ends[doc], hi - part_ends[doc], h, c))
            removed, spans, digest, texts = [], [], [], []
            for i in range(batch.num_rows):
                own = data[ends[i] : ends[i + 1]]
                if i in by_doc:
                    masks = {(x["h"] % 2**64, x["c"] % 2**64): x["mask"] for x in found[i]}
                    edge = np.zeros(len(own) + 1, np.int32)
                    for sample, lo, hi, h, c in by_doc[i]:
                        if (h, c) not in masks:
                            continue
                        mask = masks[h, c]
                        if mask is None:
                            edge[lo] += 1
                            edge[hi + length] -= 1
                        else:
                            bits = np.unpackbits(np.frombuffer(mask, np.uint8))[: reach + 1]
                            at = sample - np.flatnonzero(bits)
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + length, -1)
                    hit = edge[:-1].cumsum() > 0
                    removed.append(int(hit.sum()))
                    spans.append(int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum()))
                    own = own[~hit]
                else:
                    removed.append(0)
                    spans.append(0)
                kept = own.tobytes()
                digest.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode("utf-8", "ignore"))
            columns = [*(batch.column(k) for k in batch.schema.names if k not in ("found", "text")), pa.array(np.diff(ends)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            names = [*(k for k in batch.schema.names if k not in ("found", "text")), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_contexts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK_CONTEXTS) -> DataFrame:
    """(doc_id, h, c, mask) for each run of docs that holds a repeated string; a null mask stands for all of its strings."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    found = texts.where(F.octet_length("text") >= length).mapInArrow(_candidates(length, gram), f"h long, c long, doc_id {kind}")
    found = written(found, "suffix-found")
    buckets = found.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    buckets = written(buckets.select("h", "n", (F.col("c0") != F.col("c1")).alias("varied")), "suffix-buckets")
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a passage that very many documents share is one bucket; its rows are dealt over tasks
    candidates = written(dealt(found, buckets.drop("n"), "h", "doc_id", hot_keys(buckets, "h", "n", total)), "suffix-candidates")
    contexts = candidates.where("varied").groupBy("h", "c").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    contexts = written(contexts, "suffix-contexts")
    sizes = contexts.groupBy("h").agg(F.count("*").alias("members"))
    wanted = contexts.groupBy("doc_id").agg(F.collect_list(F.struct("h", "c", F.least("n", F.lit(2)).alias("n"))).alias("wanted"))
    texts_of = joined(texts, wanted, ["doc_id"]).mapInArrow(_contexts(length, gram), "h long, c long, n long, back long, bytes binary").join(sizes, "h")
    texts_of = written(texts_of, "suffix-texts")
    small = texts_of.where(F.col("members") <= block).drop("members")
    masks = small.repartition("h").sortWithinPartitions("h").mapInArrow(_sort(length, gram), "h long, c long, mask binary")
    large = texts_of.where(F.col("members") > block).drop("members").mapInArrow(_strings(length), "h long, c long, n long, d int, s long")
    twice = large.groupBy("h", "d", "s").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    held = large.join(twice, ["h", "d", "s"]).groupBy("h", "c").agg(F.sort_array(F.collect_set("d")).alias("ds"))
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit((length - gram) // 8 * 8 + 7)), lambda i: F.when(F.array_contains("ds", i.cast("int")), "1").otherwise("0")), "")
    packed = held.select("h", "c", F.expr("ds").alias("ds"), bits.alias("bits"))
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit((length - gram) // 8)), lambda i: F.lpad(F.conv(F.substring("bits", i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), "")
    masks = masks.unionByName(packed.select("h", "c", F.unhex(hexed).alias("mask")))
    settled = candidates.where("not varied").select("doc_id", "h", "c", F.lit(None).cast("binary").alias("mask"))
    sorted_ = dealt(candidates.where("varied"), masks, ["h", "c"], "doc_id", hot_keys(contexts, ["h", "c"], "n", total))
    return settled.unionByName(sorted_.select("doc_id", "h", "c", "mask"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK_CONTEXTS, keep_text: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): bytes, bytes removed, removed spans, digest of what is left.

    A null text is empty; texts shorter than ``length`` bytes keep all. Rows that repeat a doc_id are documents of their
    own: equal ones remove each other. Other columns of docs are left out. With keep_text the remaining text follows; a
    character cut by a removed span goes with it.
    """
    found = repeated_contexts(docs, length, gram, block).groupBy("doc_id").agg(F.collect_set(F.struct("h", "c", "mask")).alias("found"))
    texts = joined(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), found, ["doc_id"], "left")
    kind = dict(docs.dtypes)["doc_id"]
    return texts.mapInArrow(_removed(length, gram, keep_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK_CONTEXTS) -> DataFrame:
    """docs with every repeated string cut out of text, n_chars following where it is a column; all rows and columns stay."""
    found = repeated_contexts(docs, length, gram, block).groupBy("doc_id").agg(F.collect_set(F.struct("h", "c", "mask")).alias("found"))
    whole = F.struct(*(F.lit(None).cast("string").alias("text") if c == "text" else F.col(c) for c in docs.columns)).alias("whole")
    texts = joined(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), whole), found, ["doc_id"], "left")
    kept = texts.select("doc_id", "text", "whole", "found")
    kinds = dict(kept.dtypes)
    cut = kept.mapInArrow(_removed(length, gram, True), f"doc_id {kinds['doc_id']}, whole {kinds['whole']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return cut.select(*(new[c].alias(c) if c in new else F.col("whole").getField(c).alias(c) for c in docs.columns))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
