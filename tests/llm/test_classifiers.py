"""Quality, toxicity and language: held-out accuracy, gradients, and odd inputs."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.llm import labelled, langid, quality, toxicity
from pageflow.llm.common import documents, held_out, table

DIR = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 ... !!"), (4, "Ж" * 10), (5, "long " * 30_000), (6, "the and"), (6, "the and"), (None, "the and of")]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", 0.5) for i, t in ODD], "doc_id long, text string, lang string, score double")


def check_odd(rows):
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(text.encode()) % 5 == 0)


def accuracy(df, labels, name):
    j = df.where("held_out").join(labels, "doc_id")
    return j.agg(F.avg((F.col("predicted") == F.col(name)).cast("int"))).first()[0]


def test_quality(spark):
    docs, labels = documents(spark, DIR), table(spark, DIR, "labels")
    net = quality.learn(docs, labels)
    assert accuracy(quality.score(docs, net), labels, "quality") > 0.93
    check_odd(quality.score(odd(spark), net).collect())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality.score(docs, net).where("predicted = 1").count()


def test_toxicity(spark):
    docs, labels = documents(spark, DIR), table(spark, DIR, "labels")
    model = toxicity.learn(docs, labels)
    assert accuracy(toxicity.score(docs, model), labels, "toxic") > 0.93
    check_odd(toxicity.score(odd(spark), model).collect())


def test_language(spark):
    docs = documents(spark, DIR)
    model = langid.learn(docs)
    got = langid.predict(docs, model).where("held_out").join(docs, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    rows = langid.predict(odd(spark), model).collect()
    check_odd(rows)
    assert [r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)] == ["und"] * 3


def test_mixed_text_has_spans(spark):
    docs = documents(spark, DIR)
    model = langid.learn(docs)
    pick = lambda lang: docs.where((F.col("lang") == lang) & (F.length("text") > 1000)).orderBy("doc_id").first()["text"][:900]
    mixed = spark.createDataFrame([(1, pick("de") + " " + pick("fr"))], "doc_id long, text string")
    spans = [r["lang"] for r in langid.spans(mixed, model).orderBy("first").collect()]
    assert spans == ["de", "fr"]


def test_viterbi_against_a_loop():
    r = np.random.default_rng(0)
    n = np.array([3, 0, 40, 1])
    score = r.normal(0, 2, (44, 3)).astype(np.float32)
    got = langid.viterbi(score, n, 3.0)
    at = 0
    for m in n:
        own = score[at : at + m].astype(float)
        if m:
            best = {l: (own[0, l], [l]) for l in range(3)}
            for t in range(1, m):
                best = {l: max(((s - (3.0 if p != l else 0) + own[t, l], [*path, l]) for p, (s, path) in best.items()), key=lambda x: x[0]) for l in range(3)}
            assert got[at : at + m].tolist() == max(best.values(), key=lambda x: x[0])[1]
        at += m


def test_no_training_rows(spark):
    none = odd(spark).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality(odd(spark), labels).collect()} == {1.0}
    assert all(r["score"] < 0.01 for r in toxicity.toxicity(odd(spark), labels).collect())
    assert {r["lang_pred"] for r in langid.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert quality.quality(none, labels).count() == 0 and langid.identify(none).count() == 0


def test_labels_that_differ_are_left_out(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(0, 1), (2, None)], "doc_id long, toxic int")
    ids = {r["doc_id"] for r in labelled.training_sample(docs, labels, "toxic", 100).collect()}
    assert ids == {i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 5}
    assert docs.where(held_out()).count() == 20 - sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20))


def test_gradient_of_the_net():
    r = np.random.default_rng(1)
    net = quality.Net.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, n, y, w = r.random((5, quality.WIDTH)) * 0.1, np.array([2, 3]), np.array([1.0, 0.0]), np.array([1.0, 0.5])
    loss = lambda: -float((w * (y * np.log(net.forward(x, n)[-1]) + (1 - y) * np.log(1 - net.forward(x, n)[-1]))).sum())
    g = net.gradient(x, n, y, w)
    for k in quality.Net.NAMES:
        flat = net.p[k].reshape(-1)
        for i in r.choice(flat.size, min(3, flat.size), replace=False):
            keep, eps = flat[i], 1e-5
            flat[i] = keep + eps
            up = loss()
            flat[i] = keep - eps
            down = loss()
            flat[i] = keep
            assert np.isclose(g[k].reshape(-1)[i], (up - down) / (2 * eps), rtol=1e-3, atol=1e-6)


def test_passages_cover_whole_texts():
    data = np.frombuffer(b"a" * 1300 + b"b" * 10, np.uint8)
    x, n = quality.passages(data, np.array([0, 1300, 1300, 1310]))
    assert n.tolist() == [3, 1, 1] and x.shape == (5, quality.WIDTH) and x.min() >= 0 and x.max() <= 1.01


def test_logistic_regression_finds_the_feature():
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 200)
    rows = [np.flatnonzero(np.concatenate(([v], r.integers(0, 2, 5)))) for v in y]
    start = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    index = np.concatenate(rows)
    w = labelled.fit_logistic(start, index, np.ones(len(index)), 6, y, np.ones(200), 0.1)
    assert w[0] > 3 * np.abs(w[1:6]).max()


def test_distinct_features():
    make = toxicity.Features()
    data = np.frombuffer(b"abab abab", np.uint8)
    (own,) = make(data, np.array([0, 9]))
    assert len(own) == len(set(own.tolist()))
    assert pytest.approx(len(own), abs=1) == len({(n, (b" abab abab ")[i : i + n]) for n in toxicity.ORDERS for i in range(11 - n + 1)})


def test_toxicity_scores_equal_single_features(spark):
    """Every n-gram by itself: its bucket, and the sum of the weights of a text's distinct buckets."""
    rng = np.random.default_rng(2)
    weight = np.where(rng.random(1 << toxicity.BUCKET_BITS) < 0.3, rng.normal(size=1 << toxicity.BUCKET_BITS), 0).astype(np.float32)
    got = toxicity.score(odd(spark), toxicity.Model(weight, -0.25)).collect()
    known = {}

    def bucket(gram):
        if gram not in known:
            known[gram] = int(toxicity._gram_buckets(np.frombuffer(gram, np.uint8))[toxicity.ORDERS.index(len(gram))][0])
        return known[gram]

    want = []
    for i, text in ODD:
        data, offsets = np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())])
        raw, at = toxicity.padded(data, offsets)
        raw = raw[int(at[0]) - 1 : int(at[1])].tobytes()
        assert raw.startswith(b" ") and (raw.endswith(b" ") or len(raw) < 2)
        grams = {raw[a : a + n] for n in toxicity.ORDERS for a in range(len(raw) - n + 1)}
        total = sum(float(weight[b]) for b in {bucket(g) for g in grams})
        want.append((i, 1 / (1 + np.exp(-(total - 0.25)))))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    assert np.allclose([r["score"] for r in got], [s for _, s in want])


def test_toxicity_of_no_documents(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd(spark).where("false"), labels).count() == 0
    assert toxicity.toxicity(odd(spark), labels).count() == len(ODD)
