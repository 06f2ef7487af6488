import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from barwise.llm.packing import _Encoder, pack, shares, tokenizer_path


def test_word_cache_equals_whole_texts():
    e = _Encoder(tokenizer_path())
    for t in ["", " ", "It's  fine\n\nİstanbul ΣΑΣ é x y", "a\x1cb c", "<|endoftext|> it're!!?", "́ z", "don't've 123 $%^ Straße", "It's. word%%% '' a'b' x_! ²!! e\u0301. NAÏVE!! ǅ ﬁ ªº º. İ. ΑΣ, 中文。中 word's!! <|endoftext|>!"]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_real_texts_encode_alike():
    import pyarrow.parquet as pq

    e = _Encoder(tokenizer_path())
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    for t, want in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want.ids


def test_shares_follow_targets_and_empty_the_queues():
    got = shares(np.array([5000, 3000, 200]), np.array([5000, 3000, 200]) / 8200, np.zeros(3), [2048] * 4 + [8])
    assert got.sum(0).tolist() == [5000, 3000, 200] and got.sum(1).tolist() == [2048] * 4 + [8]
    assert abs(got[:4] - 2048 * np.array([5000, 3000, 200]) / 8200).max() <= 2


def test_every_id_lies_in_one_piece(spark):
    r = random.Random(1)
    rows = [(i, None if i == 3 else " ".join(r.choice(["the", "Über", "x1", "hello,", "¿qué?"]) for _ in range(r.choice([0, 3, 50, 6000] if i % 9 == 0 else [0, 5, 200]))), r.choice(["a", "a", "b", None])) for i in range(90)]
    df = spark.createDataFrame(rows + [rows[5]], "doc_id long, text string, source string").selectExpr("*", "1 AS queue", "2 AS n", "3 AS ids")
    got = pack(df, block_tokens=5000).collect()
    e = _Encoder(tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, t, _ in rows:
        ids = np.append(np.frombuffer(e.encode(t or ""), "<u4"), 1).astype("<u4")
        times = 2 if i == 5 else 1
        at = defaultdict(int)
        for p in by_doc[i]:
            assert p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            for k in range(p.start, p.start + p.length):
                at[k] += 1
        assert dict(at) == {k: times for k in range(len(ids))}
    for ps in by_seq.values():
        ps.sort(key=lambda p: p.offset)
        end = 0
        for p in ps:
            assert p.offset == end
            end += p.length
        assert end <= 2048 and end & (end - 1) == 0


def test_empty_table_and_targets(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pack(df).collect() == []
    df = spark.createDataFrame([(i, "the " * 500, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    got = pack(df, targets={"a": 3, "b": 1}, block_tokens=10**9).where("sequence_id < 3").groupBy("source").sum("length").collect()
    assert dict((r[0], r[1]) for r in got) == {"a": 4608, "b": 1536}


def test_any_number_of_sources_keep_their_targets(spark):
    rows = [(i, "the " * 500, ["big", "mid"][i % 2]) for i in range(60)] + [(100 + i, "the " * 500, "small") for i in range(20)] + [(200 + i, "the " * 500, None) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pack(df, targets={"small": 2, None: 1, "big": 1, "none": 5}, block_tokens=10**9).where("sequence_id < 4").groupBy("source").sum("length").collect()
    assert dict((r[0], r[1]) for r in got) == {"small": 4096, "big": 2048, None: 2048}
    many = df.selectExpr("doc_id", "text", "concat('s', doc_id) AS source")
    assert pack(many, block_tokens=5000).groupBy("doc_id").sum("length").count() == len(rows)


@pytest.mark.parametrize("targets", [{"a": 1, "b": 1}, {"a": 1, "b": 3}, {"a": 9, "b": 1}])
def test_targets_unlike_the_corpus_hold_over_blocks(spark, targets):
    """80 % a, 20 % b in seven blocks: windows are at the targets for as long as both sources last, in every block."""
    rows = [(i, "the " * 99, "b" if i % 5 == 0 else "a") for i in range(7000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pack(df, targets=targets, block_tokens=100_000)
    sizes = got.groupBy("sequence_id").pivot("source", ["a", "b"]).sum("length").fillna(0).collect()
    blocks = {r.sequence_id >> 32 for r in sizes}
    assert len(blocks) == 7
    want_b = targets["b"] / sum(targets.values())
    full = [r for r in sizes if r.a + r.b == 2048]
    at_target = [r for r in full if abs(r.b / 2048 - want_b) <= 0.01]
    lasts = min(0.2 * 700_000 / want_b, 0.8 * 700_000 / (1 - want_b)) / 2048
    assert len(at_target) >= 0.93 * lasts - 2 * len(blocks)
    for b in blocks:
        own = sorted((r for r in full if r.sequence_id >> 32 == b), key=lambda r: r.sequence_id)
        flags = [abs(r.b / 2048 - want_b) <= 0.01 for r in own]
        assert flags[0] and sum(flags) >= 0.6 * lasts / len(blocks)
        assert all(flags[: sum(flags)])


def test_a_queue_that_ran_dry_owes_nothing():
    got = shares(np.array([10_000, 1_000]), np.array([0.5, 0.5]), np.zeros(2), [1000] * 11)
    assert got[:2].tolist() == [[500, 500], [500, 500]] and got[2:].tolist() == [[1000, 0]] * 9
    three = shares(np.array([6000, 3000, 300]), np.array([0.5, 0.25, 0.25]), np.zeros(3), [930] * 10)
    assert three.sum(0).tolist() == [6000, 3000, 300] and abs(three[2] - [620, 310, 0]).max() <= 2


def test_random_texts_of_all_blocks_encode_alike():
    """Words, alone and before punctuation, of every letter that normalisation or lower-casing changes, and random ones."""
    import sys
    import unicodedata

    e = _Encoder(tokenizer_path())
    r = random.Random(2)
    chars = [chr(c) for c in range(33, sys.maxunicode) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    changed = [c for c in chars if c.isalpha() and (unicodedata.normalize("NFC", c) != c or len(c.lower()) > 1)]
    texts = [f"{c}. a{c}, {c}{c}!? {c}b." for c in changed]
    texts += ["".join(r.choice(chars) if r.random() < 0.5 else r.choice("abc .,!?'-") for _ in range(r.randint(1, 12))) for _ in range(30_000)]
    texts += ["".join(r.choice(chars[i : i + 400]) if r.random() < 0.7 else r.choice(" .,;:!?") for _ in range(30)) for i in range(0, len(chars), 150)]
    for t, want in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want.ids, t


def test_latin_texts_encode_alike():
    """Letters, punctuation and white space of Latin-1 in any order; commas and full stops alone, beside others and at the ends."""
    e = _Encoder(tokenizer_path())
    r = random.Random(3)
    chars = [chr(c) for c in range(256)]
    words = ["Über", "it's", "NAÏVE", "straße", "a", "x1", "3", "²", "'s", "º", "µ", "don't've", "ÿ"]
    marks = [",", ".", ", ", ". ", ".\n", ",\n", " ,", "...", '",', " ", "\r\n", "\t", "?", "%. ", "\xa0", "\x85"]
    texts = ["".join(r.choice(chars) if r.random() < 0.3 else r.choice("aÉ .,'\n") for _ in range(r.randint(1, 15))) for _ in range(20_000)]
    texts += ["".join(r.choice(words) + r.choice(marks) for _ in range(r.randint(1, 6))) for _ in range(20_000)]
    texts += [t + " €" for t in texts[::20]]
    for t, want in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == want.ids, t


def test_ways_to_write_a_word_are_encoded_once():
    e = _Encoder(tokenizer_path())
    seen = []

    class Model:
        def tokenize(self, word):
            seen.append(word)
            return e.tokenizer.model.tokenize(word)

    e.model = Model()
    text = "Blendung, blendung. BLENDUNG Über, über: ÜBER\nblendung"
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(seen) == 2


def test_words_of_an_earlier_generation_are_kept(monkeypatch):
    monkeypatch.setattr("barwise.llm.packing._CACHE", 2)
    e = _Encoder(tokenizer_path())
    for t in ["one two three", "one four", "five six", "one two", "seven", "é one ж"]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
        assert not getattr(e.known.older, "older", None)
