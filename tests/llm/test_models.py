import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.llm import langid, quality, toxicity


def corpus(seed=1, n=700):
    r = random.Random(seed)
    sound = {"aa": "aeiou lmn", "bb": "kxz gtr o", "cc": "éßü sch n"}
    docs, labels = [], []
    for i in range(n):
        lang = r.choice(list(sound))
        words = ["".join(r.choice(sound[lang]) for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 120))]
        toxic, bad = r.random() < 0.2, r.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["scumbag", "idiotic", "loserish"]))
        text = " ".join(words)
        text = text.upper() + "!!! ### 000" if bad else text
        docs.append((i, text, lang, f"s{i % 3}", len(text)))
        if r.random() < 0.7:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(n, None, None, None, None), (n + 1, "", "aa", "s0", 0), (n + 2, "123 ... 456", "bb", "s1", 11), (None, "x y", "aa", None, 3)]
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS score", "'x' AS found")
    return docs, labels, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out(frames):
    docs, labels, d, lab = frames
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    assert len(got) == len(docs) and all(got[i].held_out == held(i) for i in got)
    own = [(got[i].predicted, t) for i, _, t in labels if held(i)]
    assert np.mean([a == b for a, b in own]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())
    assert toxicity.drop_toxic(d, lab).count() == sum(not r.predicted for r in got.values())
    assert toxicity.toxicity(d, lab.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(d.limit(0), lab).count() == 0


def test_the_risk_makes_the_weights(frames):
    """Without steps no weight is other than zero and nothing is told apart; with them held-out documents are."""
    _, labels, d, lab = frames
    (p, _), (u, _), prior = toxicity._training(d, lab, None, 4000, 8000)
    none, bias = toxicity.nnpu(p, u, prior, toxicity.Settings(steps=0))
    assert not none.any() and bias == 0.0
    weights, bias = toxicity.nnpu(p, u, prior)
    assert np.count_nonzero(weights) > 3 and bias < 0
    assert toxicity._called(p, weights, bias) > 0.9 and toxicity._called(u, weights, bias) < 2 * prior


def test_the_non_negative_correction_acts():
    """A flexible model drives the plain unbiased risk of the negatives far below zero; the correction holds it near zero, and new rows are judged better."""
    r = np.random.default_rng(3)
    prior, d = 0.3, 300
    true = np.append(r.normal(size=8), np.zeros(d - 8)) * 2

    def rows(n):
        x = (r.random((n, d)) < 0.3).astype(np.float32)
        return x, x @ true > np.quantile(x @ true, 1 - prior)

    x, y = rows(4000)
    xp, xu = x[y][:60], rows(250)[0]
    end = {}
    for corrected in (True, False):
        w, b, turned = toxicity.descend(xp, xu, prior, 600, corrected)
        s = lambda m, w=w, b=b: 1 / (1 + np.exp(-np.clip(m @ w + b, -30, 30)))
        test, label = rows(3000)
        end[corrected] = (prior * np.log1p(-s(xp)).mean() - np.log1p(-s(xu)).mean(), np.mean((s(test) >= 0.5) == label), turned)
    assert end[False][0] < -0.5 and abs(end[True][0]) < 0.1
    assert end[True][2] > 50 and end[False][2] == 0


def test_settings_are_compared_without_fold_0(frames):
    """What fold 0 says, right or wrong, changes no risk."""
    _, _, d, lab = frames
    grid = [toxicity.Settings(deviations=0.5, lift=0.5), toxicity.Settings(deviations=50.0)]
    got = toxicity.cross_validated(d, lab, grid)
    assert [s for _, s in got] == grid and got[0][0] < got[1][0]
    turned = lab.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.cross_validated(d.withColumn("text", F.when(toxicity.fold() == 0, F.lit("scumbag")).otherwise(F.col("text"))), turned, grid) == got


def test_quality_on_held_out(frames):
    docs, labels, d, lab = frames
    got = {r.doc_id: r for r in quality.quality(d, lab).collect()}
    assert len(got) == len(docs)
    assert np.mean([got[i].predicted == q for i, q, _ in labels if held(i)]) > 0.95
    assert {r.score for r in quality.quality(d, lab.limit(0)).collect()} == {0.5}
    assert quality.quality(d.limit(0), lab).count() == 0


def test_rounds_help_where_labels_are_few():
    """Two independent views and ten labels: what the views hand to each other makes both, and their sum, better on new rows."""
    gain = []
    for seed in range(5):
        r = np.random.default_rng(seed)

        def rows(n, r=r):
            y = (r.random(n) < 0.5).astype(float)
            return tuple(r.normal(size=(n, 30)) + (2 * y[:, None] - 1) * np.append(np.full(6, 0.8), np.zeros(24)) for _ in range(2)) + (y,)

        (a, b, y), (pa_, pb, _), (ta, tb, ty) = rows(24), rows(2000), rows(2000)
        held = np.arange(24) >= 12
        score = [np.mean((quality.combined(*quality.co_train(a, b, y, pa_, pb, held, rounds=k), ta, tb) >= 0.5) == ty) for k in (0, 4)]
        gain.append(score[1] - score[0])
    assert np.mean(gain) > 0.02


def test_the_metadata_view_never_sees_the_text(frames):
    docs, _, d, _ = frames
    own = quality.described(d)
    assert own.count() == len(docs) and own.agg(F.max("of_source")).first()[0] >= 200
    other = quality.described(d.withColumn("text", F.when(F.col("text").isNotNull(), F.lit("quite different"))).withColumn("n_chars", F.col("n_chars")))
    one, two = (quality.meta_view(x.where("n_chars is not null and doc_id < 700").orderBy("doc_id").toArrow().to_batches()[0]) for x in (own, other))
    assert (one == two).all() and one.any()


def test_quality_without_metadata_and_of_repeated_rows(frames):
    docs, labels, d, lab = frames
    got = quality.quality(d.select("doc_id", "text").unionByName(d.where("doc_id < 5").select("doc_id", "text")), lab).collect()
    assert len(got) == len(docs) + 5
    for i in range(5):
        assert len({r.score for r in got if r.doc_id == i}) == 1
    q = dict((i, q) for i, q, _ in labels)
    assert np.mean([r.predicted == q[r.doc_id] for r in got if r.doc_id in q and held(r.doc_id)]) > 0.9


def test_language_on_held_out(frames):
    docs, _, d, _ = frames
    got = {r.doc_id: r for r in langid.language(d).collect()}
    n = max(i for i in got if i is not None) - 2
    assert [got[k].lang_pred for k in (n, n + 1, n + 2)] == ["und"] * 3
    assert np.mean([got[x[0]].lang_pred == x[2] for x in docs if held(x[0]) and x[0] < n]) > 0.95
    assert langid.language(d.limit(0)).count() == 0


def test_gradients_and_pooling_agree_with_plain_forms():
    net = langid.BiGRU(3, hidden=4, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 50, (6, 5)).astype(np.int16), r.integers(0, 3, 5)
    x[4:, 0] = langid.PAD

    def loss():
        z = net.logits(net.states(x).astype(float))
        z = z - np.log(np.exp(z).sum(-1, keepdims=True))
        real = x != langid.PAD
        return -(z[:, np.arange(5), y] * real).sum() / real.sum()

    g = net._gradients(x, y)
    for k in net.p:
        at = tuple(np.array(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)))
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 0.02 * abs(g[k][at]) + 1e-3
    net = langid.BiGRU(3, seed=2)
    x = r.integers(0, 255, (6, 3)).astype(np.int16)
    x[np.arange(6)[:, None] >= [6, 5, 2]] = langid.PAD
    states = np.stack([np.concatenate([net.states(x[:m, [k]]), np.zeros((2, 6 - m, 1, net.h))], 1)[:, :, 0] for k, m in enumerate([6, 5, 2])], 2)
    z = np.exp(net.logits(states))
    plain = z / z.sum(-1, keepdims=True)
    assert np.allclose(net.positions(x).transpose(0, 2, 1)[x != langid.PAD], plain[x != langid.PAD], atol=1e-5)
    # a document's distribution is the mean over its bytes, segment by segment
    texts = [b"abc", b"", bytes(r.integers(0, 255, 300).astype(np.uint8))]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.array([0, 3, 3, 303])
    got = langid.pooled(net, data, ends)
    for t, p in zip(texts, got, strict=True):
        parts = [np.frombuffer(t[i : i + langid.SEGMENT], np.uint8) for i in range(0, len(t), langid.SEGMENT)]
        want = sum((net.positions(b[:, None].astype(np.int16)).sum((0, 2)) for b in parts), np.zeros(3)) / max(1, len(t))
        assert np.allclose(p, want, atol=1e-4)


def test_every_language_is_learned_from_whole_texts(spark):
    """Seventy labels, one of them with short texts only; texts open with bytes that all labels share."""
    docs = [(i, "x" * 3000 + " " + chr(0x4E00 + 16 * k) * 1500, f"l{k:02d}") for i in range(210) for k in [i % 70]]
    docs += [(1000 + i, "ЖЩ" * 3, "short") for i in range(5)]
    net, names = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), per_language=2)
    assert len(names) == net.k == 71 and "short" in names
    seen = []
    net_train, langid.BiGRU.train = langid.BiGRU.train, lambda self, x, y, **more: seen.append((x, y))
    try:
        langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"), per_language=2)
    finally:
        langid.BiGRU.train = net_train
    x, y = seen[0]
    assert set(y.tolist()) == set(range(71))
    assert all((x[y == k] > 127).any() for k in range(71))
