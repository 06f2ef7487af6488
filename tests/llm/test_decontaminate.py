import hashlib
import random
import re

from barwise.llm.decontaminate import contamination, decontaminate, near_hits


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, n=10):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for k, u in items:
            v = words(u)
            m = min(n, len(v))
            wins = {tuple(v[s : s + m]) for s in range(len(v) - m + 1)} if v else set()
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in wins:
                    hit |= set(range(s, s + m))
                    names.add(str(k))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_agrees_with_brute_force(spark):
    r = random.Random(3)
    vocab = ["the", "of", "É", "é", "x1", "Zoë"] * 3 + [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(r.choice(vocab) + r.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(k, text(r.randint(8, 30))) for k in range(12)] + [(20, "The x1"), (21, "zoë"), (22, None), (23, "..."), (24, "of of of of of of of of of of of of"), (3, "dup w1 w2 w3 w4")]
    docs = [(0, None), (1, ""), (2, "of " * 30), (3, "Zoë ZOë")]
    for i in range(4, 60):
        t = text(r.randint(0, 60))
        if r.random() < 0.6:
            v = r.choice(items)[1] or ""
            v = v.split(" ")
            a = r.randint(0, 6)
            t = t + " " + " ".join(v[a : a + r.randint(5, 25)]).upper() + " " + t[: r.randint(0, 40)]
        docs.append((i, t))
    docs += [docs[10], (None, "x " + (items[1][1] or "")), (11, "again " + (items[0][1] or ""))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS pos", "'x' AS term")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS item", "3 AS at")
    got = sorted((tuple(x) for x in contamination(d, i).collect()), key=str)
    want = brute(docs, items)
    assert got == want
    assert decontaminate(d, i).count() == sum(not x[-1] for x in want)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id long, text string")
    assert contamination(d, i).collect() == []
    one = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert decontaminate(one, i).count() == 1


def nearest(window, text):
    """Least edits between the window and any stretch of the text, and the place of the first such stretch's last word."""
    row = [0] * (len(text) + 1)
    for w in window:
        new = [row[0] + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (w != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row), row.index(min(row)) - 1


def test_proximity_agrees_with_brute_force(spark):
    r = random.Random(5)
    vocab = ["the", "of", "É"] * 4 + [f"w{k}" for k in range(60)]
    line = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(line(r.choice([1, 3, 4, 5, 7, 9, 10, 12, 18])))) for k in range(14)] + [(20, None), (21, "..."), (22, "of of of of of of of")]
    docs = [(0, None), (1, ""), (2, "of " * 12), (3, "The of")]
    for i in range(4, 70):
        v = words(r.choice(items[:14])[1])
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(v) + 1)
            v = r.choice([v[:k] + line(1) + v[k:], v[:k] + v[k + 1 :], v[:k] + line(1) + v[k + 1 :]])
        docs.append((i, " ".join(line(r.randint(0, 15)) + v + line(r.randint(0, 15))).upper()))
    docs += [docs[9], (None, items[8][1])]
    want, edited = set(), 0
    for i, t in docs:
        for k, u in items:
            v = words(u)
            for s in range(max(1, len(v) - 9) if v else 0):
                window = v[s : s + 10]
                edits, last = nearest(window, words(t))
                if words(t) and edits <= min(2, len(window) // 5):
                    want.add((i, str(k), s, edits, last))
                    edited += edits > 0
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS row", "text", "'x' AS item")
    got = [(x.doc_id, x.item_id, x["at"], x.edits, x.last) for x in near_hits(d.select("doc_id", "row", "text"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and edited > 50
    empty = spark.createDataFrame([], "doc_id long, row long, text string")
    assert near_hits(empty, spark.createDataFrame(items, "item_id long, text string")).collect() == []
