import hashlib
import random

import numpy as np

from barwise.llm import fingerprint as fp


def test_equal_texts_and_likeness():
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n)).encode()
    bits = np.random.default_rng(0).random(65536) * 8
    a, b = prose(2000), prose(2000)
    texts = [a, b, a, b"", b"x", b"y" * 64, b"y" * 300, a[:5000] + b[:2500], b"short one"]
    got = fp.digests(texts, bits)
    alone = [fp.digests([t], bits)[0] for t in texts]
    assert all(np.array_equal(x, y) for x, y in zip(got, alone, strict=True))
    assert fp.likeness(got[0], got[2]) == 1.0 and fp.likeness(got[3], got[3]) == 1.0 and fp.likeness(got[0], got[3]) == 0.0
    assert fp.likeness(got[0], got[1]) < 0.1 < 0.4 < fp.likeness(got[0], got[7])


def test_follows_descending_ids(spark):
    r = random.Random(4)
    rows = [(i * 7 % 101, None if i == 5 else "é" * r.randint(0, 5) + "".join(r.choice("abc ") for _ in range(r.randint(0, 300)))) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS tie")
    for per_range in (10, 1000):
        got = {x.doc_id: x for x in fp.with_next(df, per_range).mapInArrow(fp._compared(fp.surprise(df)), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").collect()}
        texts = {i: t or "" for i, t in rows}
        assert len(got) == 101
        for i, t in texts.items():
            nxt = texts[(i - 1) % 101]
            n = len(t) // 3
            e = (t[: len(t) - n]) + nxt[:n]
            assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    plain = {x.doc_id: x.fingerprint for x in fp.fingerprints(df).collect()}
    assert all(plain[i] == got[i].fingerprint for i in plain)
    assert fp.fingerprints(df.limit(0)).count() == 0 and fp.with_next(df.limit(0)).count() == 0


def test_equal_texts_beyond_the_places_of_a_key():
    r = np.random.default_rng(3)
    bits = r.random(65536) * 8
    small, tiny, long = (r.integers(97, 123, n).astype(np.uint8).tobytes() for n in (3000, 100, 2**24 + 5000))
    got = fp.digests([small, tiny, long, small, long, tiny], bits)
    assert all(np.array_equal(got[a], got[b]) for a, b in ((0, 3), (1, 5), (2, 4)))
    assert np.array_equal(got[3], fp.digests([small], bits)[0])


def plain_model(texts: list[bytes]) -> dict:
    """Bits of each byte pair, by counting."""
    import math

    count: dict = {}
    for t in texts:
        for a, b in zip(t[:-1], t[1:], strict=True):
            count[a, b] = count.get((a, b), 0) + 1
    whole = [sum(count.get((a, b), 0) for b in range(256)) + 128.0 for a in range(256)]
    return {(a, b): -math.log2((count.get((a, b), 0) + 0.5) / whole[a]) for a in range(256) for b in range(256)}


def plain_chain(t: bytes, bits: dict) -> list[set]:
    """Filters as sets of bits: every neighbourhood's rarest window by looking at each, then the popular ones in order."""
    mask = 2**64 - 1

    def scrambled(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * by & mask
        return x ^ (x >> 31)

    def feature(window):
        return scrambled(sum(int(fp._ROLL.table[b]) * pow(fp._ROLL.inverse, j, 2**64) for j, b in enumerate(window)) & mask)

    level = [sum(int(bits[p] * 2**30) for p in zip(w[:-1], w[1:], strict=True)) >> 20 for w in (t[i : i + fp.WIDTH] for i in range(len(t) - fp.WIDTH + 1))]
    if not t:
        picked = []
    elif len(t) < fp.WIDTH + fp.REACH:
        picked = [max(range(len(level)), key=lambda i: level[i])] if len(t) > fp.WIDTH else [0]
    else:
        rarest = [max(range(s, s + fp.REACH), key=lambda i: level[i]) for s in range(len(t) - fp.WIDTH - fp.REACH + 2)]
        runs = []
        for i in rarest:
            if runs and runs[-1][0] == i:
                runs[-1][1] += 1
            else:
                runs.append([i, 1])
        picked = [i for k, (i, n) in enumerate(runs) if n >= fp.POPULAR or k == 0]
    own = list(dict.fromkeys(feature(t[i : i + fp.WIDTH]) for i in picked))
    return [{(f >> 11 * k) % fp.BITS for f in own[a : a + fp.PER_FILTER] for k in range(fp.HASHES)} for a in range(0, len(own), fp.PER_FILTER)]


def plain_likeness(a: list[set], b: list[set]) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)

    def score(x, y):
        chance = len(x) * len(y) / fp.BITS
        return (len(x & y) - chance) / max(1e-9, min(len(x), len(y)) - chance)

    return min(1.0, sum(max(0.0, max(score(x, y) for y in b)) for x in a) / len(a))


def test_query_agrees_with_a_plain_version(spark, tmp_path):
    """All columns of op7 over a table with empty, short, equal and long texts, against windows, filters and likeness by hand."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 9)))
    texts = {i: " ".join(word() for _ in range(n)) for i, n in enumerate([0, 1, 9, 12, 14, 20, 40, 90, 200, 200, 300, 1800])}
    texts |= {12: texts[10], 13: texts[10][:900], 14: None, 20: "x" * 64, 21: "x" * 65}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in fp.op7_fingerprint(spark, str(tmp_path)).collect()}
    own = {i: t or "" for i, t in texts.items()}
    bits = plain_model([t.encode() for t in own.values()])
    order = sorted(own, reverse=True)
    chains = {i: plain_chain(t.encode(), bits) for i, t in own.items()}
    hexed = lambda chain: "".join(np.packbits([k in f for k in range(fp.BITS)]).tobytes().hex() for f in chain)
    for at, i in enumerate(order):
        t, following = own[i], order[(at + 1) % len(order)]
        n = len(t) // 3
        e = t[: len(t) - n] + own[following][:n]
        changed = plain_chain(e.encode(), bits)
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert x.fingerprint == hexed(chains[i]) and x.edited_fingerprint == hexed(changed)
        assert abs(x.near_edited - plain_likeness(chains[i], changed)) < 1e-12 and abs(x.near_next - plain_likeness(chains[i], chains[following])) < 1e-12
    assert len(got) == len(own) and max(map(len, chains.values())) >= 2
