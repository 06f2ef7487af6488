import random
import zlib
from collections import Counter

import pytest

from barwise.llm.spelling import Acceptor, near_pairs, near_words, variants, vocabulary


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def words_of(r: random.Random, n: int, letters: str, low: int, high: int) -> list[str]:
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(n)})


def test_acceptor_is_minimal_and_numbers_its_words():
    words = words_of(random.Random(1), 300, "abc", 0, 6)
    m = Acceptor(words)
    assert "" in words or not m.final[m.first]
    for i, w in enumerate(words):
        s, at = m.first, 0
        for c in w:
            s, n = m.arcs[s][c]
            at += n
        assert m.final[s] and at == i
    assert len({(f, tuple(a.items())) for f, a in zip(m.final, m.arcs, strict=True)}) == len(m.arcs)
    assert len(Acceptor(["taps", "tops"]).arcs) == len(Acceptor(["tops"]).arcs)


def test_composition_accepts_all_pairs_once():
    for seed in range(6):
        words = words_of(random.Random(seed), 120, "ab" if seed % 2 else "abcd", 0, 6)
        got = [tuple(sorted((words[i], words[j]))) for i, j, _ in near_pairs(words)]
        want = sorted((a, b) for k, a in enumerate(words) for b in words[k + 1 :] if one_edit(a, b))
        assert sorted(got) == want


@pytest.mark.parametrize(("limit", "chars"), [(4096, 200_000), (6, 200_000), (4096, 90)])
def test_near_words_agree_with_brute_force(spark, limit, chars):
    r = random.Random(3)
    words = set(words_of(r, 150, "ab", 7, 10)) | {"prefix" + w for w in words_of(r, 120, "abé", 1, 4)} | {w + "suffixes" for w in words_of(r, 60, "ab", 0, 4)}
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = [tuple(sorted((x.a, x.b))) for x in near_words(df, 7, limit, chars).collect()]
    order = sorted(words)
    assert sorted(got) == sorted((a, b) for k, a in enumerate(order) for b in order[k + 1 :] if one_edit(a, b))


def vocabulary_of(rows) -> dict[str, int]:
    import re

    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def variants_of(words: dict[str, int]) -> list[tuple]:
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def test_whole_operator_on_texts(spark):
    r = random.Random(5)
    forms = ["colourful", "separate", "naïvetés", "Äquator÷", "×occurrence", "accommodate"]
    texts = []
    for i in range(300):
        own = []
        for _ in range(60):
            w = r.choice(forms)
            k = r.randrange(len(w))
            own.append(r.choice([w, w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + "x" + w[k:]]) if r.random() < 0.1 else w)
        texts.append((i, r.choice([" ", ", ", "1", "Ā", "\n"]).join(own)))
    rows = [*texts, texts[0], (None, "separate separate SEPARATE"), (900, None), (901, ""), (902, "short words only"), (903, "a" * 9000 + " " + "a" * 9001), (904, "a" * 9000 + " " + "a" * 9001 + " " + "a" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS run", "4 AS h", "5 AS key")
    words = vocabulary(df).cache()
    want = vocabulary_of(rows)
    assert {x.word: x.n for x in words.collect()} == want and len(want) > 100
    got = [tuple(x) for x in variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(got, key=lambda x: x[0]) == variants_of(want)


def test_chains_of_forms_and_ties(spark):
    words = {"wordone": 1, "wordones": 10, "wordoness": 100, "wordonesss": 1000, "wordonesssx": 10_000, "tiebaaa": 3, "tiebaab": 30, "tiebaac": 30, "lonesome": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {x.word: x for x in variants(df).collect()}
    assert got["wordone"].form == "wordones" and got["wordone"].root == "wordonesssx"
    assert got["tiebaaa"].form == "tiebaab" and got["tiebaab"].form is None and got["tiebaab"].root == "tiebaab"
    assert got["lonesome"].n_near == 0 and got["lonesome"].root == "lonesome" and got["lonesome"].form_n is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert variants(vocabulary(df)).collect() == []


def test_one_state_that_holds_a_third_of_all_words(spark):
    """Words of one half: the partition is split by more of what its words share, and loses no pair."""
    r = random.Random(9)
    words = {"samehalfsame" + "".join(r.choice("abcdefghij") for _ in range(12)) for _ in range(3000)}
    words |= {w[:k] + "z" + w[k + 1 :] for w in list(words)[:500] for k in (13, 17, 23)} | {"x" + w for w in list(words)[:300]}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {tuple(sorted((x.a, x.b))) for x in near_words(df, 7, 200).collect()}
    rests = {}
    for w in words:
        for k in range(len(w)):
            rests.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    want = {tuple(sorted((a, b))) for g in rests.values() for a in g for b in g if a < b} | {tuple(sorted((w, c))) for (_, c), g in rests.items() if c in words for w in g}
    assert got == want and len(want) >= 1500
