import random
import re

import numpy as np

import barwise.llm.near_dedup as near_dedup_module
from barwise.llm.common import written
from barwise.llm.near_dedup import near_classes, near_dedup, sketches


def brute(rows, width, pct):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= pct * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)), key=lambda k: rows[k][0])
                up[b] = a
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows)))


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 6)))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE two"), (5, "É x"), (6, "é x"), (7, "a a a a a a a")]
    i = 8
    for _ in range(25):
        base = [word() for _ in range(r.randint(60, 200))]
        for _ in range(r.randint(1, 7)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
                t[r.randrange(len(t))] = word()
            rows.append((i, " ".join(t).title() if r.random() < 0.2 else "\n".join(t)))
            i += 1
    r.shuffle(rows)
    return [(k, t) for k, (_, t) in enumerate(rows)]


def test_agrees_with_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, pct in ((3, 85), (5, 80)):
        assert sorted(tuple(x) for x in near_classes(df, width, pct).collect()) == brute(rows, width, pct)


def test_empty_table_extra_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, a long, b long, component_id long")
    assert near_dedup(df).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "a b c d e f", 2)], "doc_id long, text string, node long")
    assert near_dedup(df).count() == 2


def test_families_inside_a_large_template_group(spark):
    """Texts of one template, all of them just below the similarity, hold families of copies; no link between those is lost."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    for width, pct, own in ((3, 85, 50), (5, 80, 70)):
        template, rows, families = [word() for _ in range(400)], [], []
        for k in range(500):
            tail = [word() for _ in range(own)]
            family = range(len(rows), len(rows) + (2 if k % 10 == 0 else 1))
            for _ in family:
                t = template + tail
                t[-r.randrange(1, own)] = word()
                rows.append((len(rows), " ".join(t)))
            if len(family) > 1:
                families.append(tuple(family))
        got = sorted(tuple(x) for x in near_classes(spark.createDataFrame(rows, "doc_id long, text string"), width, pct).collect())
        component = {i: c for i, _, c in got}
        recall = sum(component[a] == component[b] for a, b in families) / len(families)
        assert recall == 1.0, f"recall {recall} at {pct} %"
        assert got == brute(rows, width, pct)


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(4)
    for n in (0, 1, 40, 3000):
        one = r.integers(0, 2**63, n).astype(np.uint64)
        for changed in (0, 1, n // 10, n):
            two = np.concatenate([one[changed:], r.integers(0, 2**63, changed).astype(np.uint64)])
            a, b = (list(x.values()) for x in sketches([one, two]).to_pylist())
            assert sum(((x ^ y) & 2**64 - 1).bit_count() for x, y in zip(a, b, strict=True)) <= len(np.setxor1d(one, two))


def test_texts_read_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    """One template, edited lightly or heavily: those far from it meet the whole group, and few pairs of texts are read for it."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    base, rows = [word() for _ in range(150)], []
    for i in range(600):
        t = list(base)
        for k in r.sample(range(150), r.choice([1, 2, 3, 5, 6, 7, 8])):
            t[k] = word()
        rows.append((i, " ".join(t)))
    read = []

    def counted(df, name):
        got = written(df, name)
        read.extend([got.count()] if name == "near-candidates" else [])
        return got

    monkeypatch.setattr(near_dedup_module, "written", counted)
    got = sorted(tuple(x) for x in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows, 5, 80)
    assert sum(read) <= 12 * len(rows), read
