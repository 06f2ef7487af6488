"""Mixture-controlled packing of tokenized documents into windows by deficit round-robin.

Every source has a queue of tokens. A window gives each queue that holds tokens a quantum in proportion to its target share; what
a queue was owed and did not get stays in its deficit and counts in the next window. A queue that has run empty is owed nothing,
and its share goes to the others, so scarce sources are at their target for as long as they last. Documents are dealt to blocks
by a hash of their id, so that no source gathers in one task and each block holds about the corpus mixture. A block opens with
the fraction of a token by which the targets are ahead after the tokens of all blocks before it.

A block's last tokens fill sequences of descending powers of two, which need no padding.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from codecs import charmap_decode

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barwise.llm.common import joined, table, written

WINDOW = 2048
END_ID = 1
#: Tokens of a block on average; a block is one task's work.
BLOCK_TOKENS = 4_000_000
#: Words that an encoder keeps in each of two generations.
_CACHE = 150_000
# White space that other splitters see differently; a text with any of it is encoded whole.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Punctuation that may end a word; the pre-tokenizer cuts between the word's letters and it.
_POINTS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


_LETTERS = "".join(_byte_letters())
# Latin-1 texts are lower-cased as bytes at once; their odd white space is left out, so that a shorter result has some.
_LOW = bytes(ord(chr(b).lower()) for b in range(256))
_ODD_LATIN = bytes(b for b in range(256) if _ODD.match(chr(b)))
_POINTS_LATIN = _POINTS.encode()
# Where no two of what is neither letter, number nor white space stand together, commas and full stops end words alone.
_KINDS = bytes(32 if chr(b).isspace() else 97 if unicodedata.category(chr(b))[0] in "LN" else 46 for b in range(256))
_ALONE = [(mark + space, b" " + mark + b" ") for mark in (b",", b".") for space in (b" ", b"\n")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Words to their ids as bytes; one that is not here comes from the generation before or is encoded."""

    def __init__(self, encode, older: dict):
        super().__init__()
        self._encode, self.older = encode, older

    def __missing__(self, word: bytes | str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._encode(word)
        self[word] = ids
        return ids


class _Encoder:
    """Token ids of texts as bytes of little-endian 32-bit ids; words between white space are encoded once and kept.

    Lower-casing and composition are the tokenizer's normalization. In texts of Latin-1 alone, which hold nothing to compose, words
    are lower-cased bytes, so that one entry serves every way to write a word; in others they are strings as they stand. A word of
    letters alone is one pre-token, so it goes straight to the tokenizer's model; others take the whole way.
    """

    _made: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _Words(self._word, {})

    @classmethod
    def of(cls, path: str) -> "_Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _latin(self, word: bytes) -> bytes:
        """Ids of a lower-case Latin-1 word that is not known yet: letters, perhaps with punctuation after them, or anything else."""
        core = word.rstrip(_POINTS_LATIN)
        if core.isalpha():  # of ASCII
            if len(core) < len(word):
                return self.known[core] + self.known[word[len(core) :]]
            return self._letters(core.decode())
        text = word.decode("latin-1")
        if text[: len(core)].isalpha():
            if len(core) < len(word):
                return self.known[core] + self.known[word[len(core) :]]
            return self._letters(charmap_decode(text.encode(), "strict", _LETTERS)[0])
        return self._whole(text)

    def _word(self, word: bytes | str) -> bytes:
        """As _latin for a word of any letters, as it stands in its text."""
        if type(word) is bytes:
            return self._latin(word)
        core = word.rstrip(_POINTS)
        if core.isalpha():
            if core.isascii():
                low = core.lower()
            else:
                low = "".join(c.lower() for c in unicodedata.normalize("NFC", core))
            # letters may become letters with marks behind them, which the pre-tokenizer puts to the punctuation
            if low.isalpha():
                if len(core) < len(word):
                    return self.known[core] + self.known[word[len(core) :]]
                return self._letters(charmap_decode(low.encode(), "strict", _LETTERS)[0])
        return self._whole(word)

    def _letters(self, word: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(word)])

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return self._whole(text)
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            if _ODD.search(text):
                return self._whole(text)
            words = text.split()
        else:
            low = raw.translate(_LOW, _ODD_LATIN)
            if len(low) < len(raw):
                return self._whole(text)
            if b".." not in low.translate(_KINDS):
                for mark, alone in _ALONE:
                    low = low.replace(mark, alone)
            words = low.split()
        if len(self.known) > _CACHE:
            self.known.older = {}
            self.known = _Words(self._word, self.known)
        return b"".join(map(self.known.__getitem__, words))


def _tokens(path: str, end_id: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _Encoder.of(path)
        for batch in batches:
            ids, texts, sources, size = [], batch.column("text"), batch.column("source"), 0
            first = 0
            for i in range(batch.num_rows):
                ids.append(encoder.encode(texts[i].as_py() or "") + tail)
                size += len(ids[-1])
                if size > 4_000_000 or i + 1 == batch.num_rows:
                    n = i + 1 - first
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), sources.slice(first, n), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "source", "ids", "n"])
                    ids, size, first = [], 0, i + 1

    return run


def _sizes(total: int, window: int) -> list[int]:
    """Whole windows, then the rest as powers of two."""
    rest = total % window
    return [window] * (total // window) + [1 << k for k in range(window.bit_length(), -1, -1) if rest >> k & 1]


def shares(available: np.ndarray, target: np.ndarray, deficit: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Tokens of each queue in each window: deficit round-robin until the queues are empty. Queues without a target come last."""
    left, owed = available.copy(), deficit.astype(float).copy()
    out = np.zeros((len(sizes), len(left)), np.int64)
    weight = None
    for w, room in enumerate(sizes):
        if weight is None or (weight > 0)[left == 0].any():
            weight = np.where(left > 0, target, 0.0)
            if not weight.sum():
                weight = left.astype(float)
            weight = weight / max(weight.sum(), 1e-300)
            owed[weight == 0] = 0.0
        owed += weight * room
        take = np.minimum(left, np.maximum(0, np.floor(owed))).astype(np.int64)
        if take.sum() > room:
            take = np.floor(take * (room / take.sum())).astype(np.int64)
        room -= int(take.sum())
        while room:
            # first fractions, the largest ahead; then what empty queues leave, by weight
            open_ = (left > take) & (weight > 0)
            if not open_.any():
                open_ = left > take
            part = np.where(open_, np.maximum(weight, 1e-12), 0)
            more = np.minimum(left - take, np.floor(room * part / part.sum())).astype(np.int64) if room > len(left) else np.zeros_like(take)
            if not more.any():
                first = np.argsort(np.where(open_, take - owed, np.inf), kind="stable")[: min(room, int(open_.sum()))]
                more[first] = 1
            take += more
            room -= int(more.sum())
        out[w] = take
        left -= take
        # what a queue got of the share of empty ones is no debt, nor is it owed anything when it is empty itself
        owed = np.where(left > 0, np.clip(owed - take, -1.0, sizes[w]), 0.0)
    return out


def _pack(window: int):
    """One block: rows (doc_id, source, ids, n) and the share and opening deficit of each source in it to pieces."""

    def run(docs: pa.Table, carry: pa.Table) -> pa.Table:
        columns: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")}
        if not docs.num_rows:
            return pa.table({**{k: pa.array([], pa.int64()) for k in columns if k not in ("doc_id", "source")}, "doc_id": docs.column("doc_id"), "source": pa.array([], pa.string())})
        block = docs.column("block")[0].as_py()
        docs = docs.sort_by([("source", "ascending"), ("order", "ascending"), ("doc_id", "ascending"), ("n", "ascending")])
        queue = docs.column("source").to_pylist()
        n = docs.column("n").to_numpy()
        names = list(dict.fromkeys(queue))
        bounds = np.flatnonzero([True] + [a != b for a, b in zip(queue[1:], queue[:-1], strict=True)] + [True])
        ends = np.concatenate([[0], n.cumsum()])
        available = ends[bounds[1:]] - ends[bounds[:-1]]
        shared = {q: (s, d) for q, s, d in zip(*(carry.column(c).to_pylist() for c in ("source", "share", "deficit")), strict=True)}
        target = np.array([shared[q][0] for q in names])
        sizes = _sizes(int(available.sum()), window)
        got = shares(available, target / max(target.sum(), 1e-12), np.array([shared[q][1] for q in names]), sizes)
        offsets = got.cumsum(axis=1) - got
        ids = [np.frombuffer(x.as_buffer(), np.uint8) for chunk in docs.column("ids").chunks for x in chunk]
        doc_ids = docs.column("doc_id").combine_chunks()
        rows, starts, long, crc, total, sequence, offset = [], [], [], [], [], [], []
        for q in range(len(names)):
            cuts = np.concatenate([[0], got[:, q].cumsum()]) + ends[bounds[q]]
            edges = np.unique(np.concatenate([cuts, ends[bounds[q] : bounds[q + 1] + 1]]))
            a, b = edges[:-1], edges[1:]
            row = np.searchsorted(ends, a, side="right") - 1
            win = np.searchsorted(cuts, a, side="right") - 1
            start = a - ends[row]
            rows += row.tolist()
            starts += start.tolist()
            long += (b - a).tolist()
            crc += [zlib.crc32(ids[r][4 * s : 4 * (s + m)]) for r, s, m in zip(row.tolist(), start.tolist(), (b - a).tolist(), strict=True)]
            total += n[row].tolist()
            sequence += (win + (block << 32)).tolist()
            offset += (offsets[win, q] + a - cuts[win]).tolist()
        return pa.table({"doc_id": doc_ids.take(pa.array(rows)), "start": pa.array(starts), "length": pa.array(long), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total), "sequence_id": pa.array(sequence), "offset": pa.array(offset), "source": docs.column("source").combine_chunks().take(pa.array(rows))})

    return run


def pack(docs: DataFrame, path: str | None = None, targets: dict[str | None, float] | None = None, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece of docs (doc_id, text, source): where it starts in its document's ids, how long it is, and where it lies.

    Every source is a queue; targets weighs them (without: corpus shares of tokens), and a source without weight comes last. A
    null text is empty and gives the end id alone; a null source is a source. Rows that repeat a doc_id are packed each. Other
    columns of docs are left out.
    """
    kind = dict(docs.dtypes)["doc_id"]
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", source.alias("source"))
    tokens = written(rows.mapInArrow(_tokens(path or tokenizer_path(), END_ID), f"doc_id {kind}, source string, ids binary, n long"), "pack-tokens")
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_tokens))
    dealt = tokens.withColumn("order", F.xxhash64("doc_id")).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(blocks)))
    sums = written(dealt.groupBy("block", "source").agg(F.sum("n").alias("n")), "pack-sums")
    weighed = sums.groupBy("source").agg(F.sum("n").cast("double").alias("weight"))
    if targets is not None:
        given = tokens.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, given double")
        weighed = joined(weighed, given, ["source"], "left").select("source", F.coalesce("given", F.lit(0.0)).alias("weight"))
    whole = weighed.agg(F.sum("weight").alias("whole"))
    share = weighed.join(F.broadcast(whole)).select("source", F.coalesce(F.try_divide("weight", "whole"), F.lit(0.0)).alias("share"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    all_before = sums.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("all_before"))
    ahead = F.col("share") * F.col("all_before")
    carry = joined(sums.join(all_before, "block"), share, ["source"]).select("block", "source", "share", (ahead - F.floor(ahead)).alias("deficit"))
    carry = written(carry, "pack-carry")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return dealt.groupBy("block").cogroup(carry.groupBy("block")).applyInArrow(_pack(window), schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op1_packing": op1_packing}
