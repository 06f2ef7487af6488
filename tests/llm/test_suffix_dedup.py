import hashlib
import random
from collections import Counter

import pytest

from barwise.llm import common
from barwise.llm.suffix_dedup import suffix_dedup


def brute(rows, length=200):
    count = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] += 1
    out = []
    for i, b in data:
        hit = [False] * len(b)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                hit[s : s + length] = [True] * length
        kept = bytes(x for x, y in zip(b, hit) if not y)
        spans = sum(y and not (j and hit[j - 1]) for j, y in enumerate(hit))
        out.append((i, len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(80), prose(45), "ab" * 400, "x" * 900]
    rows = [(0, None), (1, ""), (2, "short"), (3, "x" * 199), (4, "x" * 200), (5, "y" * 201)]
    for i in range(6, 60):
        t = prose(r.randint(5, 120))
        for _ in range(r.randint(0, 2)):
            s = r.choice(shared)
            cut = r.randint(0, len(s) // 2)
            t = t + s[cut : cut + r.randint(150, 500)] + prose(r.randint(0, 30))
        rows.append((i, t))
    rows += [(None, rows[12][1] + "q"), (60, rows[10][1]), (61, rows[10][1]), (62, rows[11][1] + "z"), (20, rows[20][1]), (7, prose(60))]
    return rows


@pytest.mark.parametrize("block", [16384, 3])
def test_agrees_with_brute_force(spark, block):
    rows = corpus(block)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x) for x in suffix_dedup(df, block=block).collect()), key=str)
    assert got == brute(rows)


def test_hot_buckets_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    monkeypatch.setattr(common, "DEALT", 200)
    rows = corpus(7)
    got = sorted((tuple(x) for x in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, h long, c long, n int, found string")
    assert suffix_dedup(df).collect() == []
    df = spark.createDataFrame([(1, "a" * 300, 1, "q")], "doc_id long, text string, h long, mask string")
    assert suffix_dedup(df, keep_text=True).collect()[0].kept_text == ""
