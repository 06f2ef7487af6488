import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.llm import codes, topk

ODD = [(900, None, 1), (901, [1.0, None, 0.5], 1), (902, [float("nan")] * 3, None), (903, [float("inf"), 0.0, 0.0], 2), (None, [0.25, 0.5, -0.25], 3)]


def table_of(spark, rows, **more):
    df = spark.createDataFrame([(i, v, lb) for i, v, lb in rows], "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", *(f"{v} AS {k}" for k, v in more.items()))


def vectors(seed: int, n: int, d: int, groups: int = 6) -> list:
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, d))
    return [(int(i), (middle[i % groups] + r.normal(size=d) * 0.3).astype(np.float32).tolist(), int(i % groups) if i % 5 else None) for i in range(n)]


def whole(rows) -> list:
    return [(i, [math.floor(256 * float(x)) for x in v], lb) for i, v, lb in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


# --- top k


def best(rows, every, k):
    own = [(i, v) for i, v, _ in whole(rows) if i is not None]
    out = []
    for i, q in own:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in own if j != i)
            out += [(i, k_ + 1, j, -s) for k_, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("pivots", "block", "asked"), [(64, 1 << 16, 1 << 14), (5, 16 * 20, 16 * 3), (1, 16, 16)])
def test_top_k_agrees_with_brute_force(spark, pivots, block, asked):
    rows = vectors(2, 700, 16) + ODD + [(2000 + i, [0.1] * 16, 1) for i in range(60)] + [(3000 + i, [0.0] * 16, 1) for i in range(30)]
    got = topk.exact_top_k(table_of(spark, rows, score=1, rank=2, v=3, norm=4), 10, 5, pivots=pivots, sample=100, block=block, asked=asked)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best(rows, 10, 5)


def test_annuli_are_left_out_by_their_bounds_and_no_score_is_lost(spark):
    """Well apart groups: most pairs of query and annulus are never scanned."""
    r = np.random.default_rng(4)
    middle = r.normal(size=(12, 8)) * 4
    rows = [(i, (middle[i % 12] + r.normal(size=8) * 0.05).astype(np.float32).tolist(), 0) for i in range(1200)]
    prepared = topk.prepared(table_of(spark, rows))
    index = topk.indexed(prepared, pivots=12, sample=400, block=8 * 30)
    assert len(index.annuli.size) >= 20 and index.annuli.size.sum() == 1200 and index.blocks.agg(F.sum("n")).first()[0] == 1200
    asking = prepared.where("vec_id % 10 = 0").select("vec_id", "v")
    got = sorted(map(tuple, topk.searched(index, asking, 5).collect()))
    assert got == best(rows, 10, 5)
    last = asking.join(spark.createDataFrame([(x[0], x[3]) for x in got if x[1] == 5], "vec_id long, reach long"), "vec_id")
    visits = last.mapInArrow(topk._visits((index.pivots, index.annuli), 5, 100, False), "annulus int, asked int, query_ids binary, queries binary, reach binary").agg(F.sum("asked")).first()[0]
    assert (visits or 0) < 0.3 * 120 * len(index.annuli.size)


def test_bounds_hold_for_every_vector():
    r = np.random.default_rng(5)
    x, q = r.integers(-300, 300, (500, 6)), r.integers(-900, 900, (40, 6))
    p = topk.Pivots(np.zeros((1, 7)), int((x**2).sum(1).max()), 6)
    p = p._replace(points=p.lifted(x)[:9])
    d = p.distances(p.lifted(x))
    ring = topk.Annuli(d.argmin(1), d.min(1), d.min(1), np.ones(500, int))
    dq = p.distances(np.concatenate([q, np.zeros((40, 1))], 1))
    true = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + p.greatest - 2.0 * q @ x.T))
    assert (ring.bounds(dq) <= true + p.slack).all()


def test_top_k_of_uneven_repeated_and_large_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [3.0], 1), (2, [], 1), (3, [-1.0, 0.5, 2.0], 1), (4, [60000.0, -60000.0], 1), (5, [1.0, 2.0], 2), (0, [9.0, 9.0], 7), (5, [1.0, 2.0], 2)]
    got = topk.exact_top_k(table_of(spark, rows), 5, 3)
    least = [x for x in rows[:6]]
    assert sorted(map(tuple, got.collect())) == best(least, 5, 3)


def test_top_k_of_empty_and_tiny_tables(spark):
    assert topk.exact_top_k(table_of(spark, []), 50).collect() == []
    assert topk.exact_top_k(table_of(spark, ODD), 50).collect() == []
    assert topk.exact_top_k(table_of(spark, [(0, [1.0], 1)]), 50).collect() == []
    assert list(map(tuple, topk.exact_top_k(table_of(spark, [(0, [1.0], 1), (7, [0.5], 1)]), 50).collect())) == [(0, 1, 7, 256 * 128)]


def test_products_beyond_floating_point_are_exact():
    q, x = np.array([[1 << 24, 3]]), np.array([[(1 << 24) - 1, 1], [1 << 24, -(1 << 24)]])
    wide = topk.products(np.repeat(q, 40, 1), np.repeat(x, 40, 1))
    assert wide.tolist() == [[sum(int(a) * int(b) for a, b in zip(np.repeat(q, 40, 1)[0], v, strict=True)) for v in np.repeat(x, 40, 1)]]


# --- codes


@pytest.mark.parametrize(("n", "k", "d", "spread"), [(400, 64, 4, 60), (300, 17, 1, 8), (200, 1, 3, 9), (300, 64, 2, 2)])
def test_orchard_search_is_exact_with_ties(n, k, d, spread):
    r = np.random.default_rng(k)
    book, x = r.integers(-spread, spread, (k, d)), r.integers(-2 * spread, 2 * spread, (n, d))
    gap = ((x[:, None] - book[None]) ** 2).sum(2)
    got, distance = codes.Orchard(book).nearest(x)
    assert (got == gap.argmin(1)).all() and (distance == gap.min(1)).all()


def test_orchard_search_reads_few_entries():
    r = np.random.default_rng(1)
    book = r.integers(-1000, 1000, (64, 4))
    o = codes.Orchard(book)
    x = book[r.integers(0, 64, 200)] + r.integers(-5, 5, (200, 4))
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, i):
            if isinstance(i, np.ndarray) and i.ndim == 1:
                read.append(len(i))
            return super().__getitem__(i)

    o.book = o.book.view(Counted)
    o.nearest(x)
    assert sum(read) < 200 * 40


def compressed_of(rows, parts=16, entries=64, rounds=2):
    """In plain Python, by the words of the contract."""
    own = sorted(whole(rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    width = max((len(v) for _, v, _ in own), default=0)
    size = -(-width // parts)
    cut = [[(v + [0] * (parts * size - len(v)))[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in own]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups: dict = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for e, xs in groups.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label: dict = {}
    for (_, _, lb), e in zip(own, error, strict=True):
        by_label[lb] = by_label.get(lb, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, by_label[lb], digest) for (i, _, lb), f, err in zip(own, found, error, strict=True)), key=str)


@pytest.mark.parametrize("rows", [vectors(3, 300, 32) + ODD, vectors(7, 40, 16) + [(3, [0.5] * 16, None), (3, [0.5] * 16, None)], [(0, [1.0, 2.0], 1), (1, [3.0], 1), (2, [], None), (3, [-1.0, 0.5, 2.0], 1)], [(5, [], 1)], ODD, []])
def test_codes_agree_with_the_plain_version(spark, rows):
    got = codes.compressed(table_of(spark, rows, code="'x'", error=1, v=2, n=3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == compressed_of(rows)


def test_codes_without_a_label_column(spark):
    df = table_of(spark, vectors(3, 100, 16)).drop("label")
    got = codes.compressed(df).collect()
    assert len(got) == 100 and {x.label_error for x in got} == {sum(x.error for x in got)}


def test_compression_error_is_small(spark):
    rows = vectors(11, 600, 32)
    got = codes.compressed(table_of(spark, rows)).agg(F.sum("error")).first()[0]
    x = np.array([v for _, v, _ in whole(rows)])
    assert got < 0.2 * ((x - x.mean(0)) ** 2).sum()
