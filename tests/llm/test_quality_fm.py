"""Factorisation machine: score against the sum over pairs, gradient against differences, held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import quality_fm as q

TEXTS = [b"", b" \n\t ", b"one", "Größe und the THE the.\nnew line 12 ###".encode(), b"word " * 3000, b"x" * 70_000, b"a b c"]


def machine():
    rng = np.random.default_rng(3)
    return q.Machine(0.25, rng.normal(size=q.SIZE), rng.normal(size=(q.SIZE, q.FACTORS)))


def rows(texts):
    starts, index, value = q.features(texts, np.array([np.nan if i % 3 == 0 else 10.0 * i for i in range(len(texts))]))
    ends = np.append(starts[1:], len(index))
    return [(index[a:b], value[a:b].astype(float)) for a, b in zip(starts, ends, strict=True)], (starts, index, value)


def test_raw_is_the_sum_over_pairs():
    m = machine()
    each, packed = rows(TEXTS[:4])
    got = m.raw(*packed)[0]
    for (index, value), raw in zip(each, got, strict=True):
        want = m.bias + sum(m.linear[i] * x for i, x in zip(index, value, strict=True))
        for a in range(len(index)):
            for b in range(a):
                want += m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b]
        assert raw == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_gradient_against_differences():
    m, (starts, index, value) = machine(), rows(TEXTS[:4])[1]
    m.linear, m.factors = m.linear / 50, m.factors / 50
    label = np.array([0.0, 1.0, 0.5, 1.0])

    def loss():
        p = q.logistic(m.raw(starts, index, value)[0])
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).sum()

    got, (bias, n) = m.gradient(starts, index, value, label)
    assert n == 4
    for i in {int(x) for x in index[:: max(1, len(index) // 12)]}:
        for k in (0, 1, q.FACTORS):
            place = (m.linear, i) if k == 0 else (m.factors, (i, k - 1))
            kept, h = place[0][place[1]], 1e-5
            place[0][place[1]] = kept + h
            up = loss()
            place[0][place[1]] = kept - h
            down = loss()
            place[0][place[1]] = kept
            assert got[i, k] == pytest.approx((up - down) / (2 * h), rel=1e-3, abs=1e-5)
    kept, m.bias = m.bias, m.bias + 1e-5
    up = loss()
    m.bias = kept - 1e-5
    assert bias == pytest.approx((up - loss()) / 2e-5, rel=1e-3)


def test_features_word_weights():
    (index, value), = rows([b"the cat the"])[0]
    words = index < q.WORD_BUCKETS
    assert sorted(value[words].round(6)) == sorted((np.array([1.0, 1 + np.log(2)]) / np.hypot(1, 1 + np.log(2))).round(6))
    assert (~words).sum() == q.STATISTICS
    # a text's features do not depend on the texts beside it
    alone, together = rows([TEXTS[3]])[0][0], q.features([TEXTS[4], TEXTS[5], TEXTS[3]], np.array([1.0, 2.0, np.nan]))
    assert np.array_equal(alone[0], together[1][together[0][2] :]) and np.allclose(alone[1], together[2][together[0][2] :])


def brute_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = q.classify(docs, labels)
    assert out.count() == docs.count()
    known = out.join(labels, "doc_id").where("held_out").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.avg("quality").alias("ones"), F.count("*").alias("n")).first()
    print(known)
    assert known.n > 1000 and known.right > 0.98 > known.ones


def test_odd_rows(spark):
    docs = [(i, f"plain words of text number {i} and some more of them", "s", 50) for i in range(40)]
    docs += [(100 + i, "### $$$ " * 5 + f"&&& {i}", "s", None) for i in range(40)]
    docs += [(None, "plain words", "s", 3), (7, "again the id", "s", -5), (901, None, "s", None), (902, "", "s", 0), (903, "word " * 20_000, "s", 10**15)]
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(5, 0), (5, 1), (None, 1), (8, 7), (9, None), (12345, 0)]
    df = spark.createDataFrame([(*d, 3, "clash") for d in docs], "doc_id long, text string, source string, n_chars long, predicted int, label string")
    lb = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, text string")
    out = q.classify(df, lb, max_train=None).collect()
    assert len(out) == len(docs)
    assert sorted(map(str, (r.doc_id for r in out))) == sorted(str(d[0]) for d in docs)
    for r in out:
        assert r.held_out == brute_held_out(r.doc_id)
        assert 0 <= r.score <= 1 and r.predicted == (1 if r.score >= 0.5 else 0)
        if r.doc_id is not None and r.held_out and r.doc_id < 200:
            assert r.predicted == (r.doc_id < 100), r


def test_labels_other_columns_do_not_count(spark):
    docs = spark.createDataFrame([(i, ("good " if i % 2 else "### bad ") * 8, str(i % 2), str(i % 2), 9) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    a = q.classify(docs, labels).collect()
    b = q.classify(docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")), labels).collect()
    flipped = labels.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    c = q.classify(docs, flipped).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in a} == {(r.doc_id, round(r.score, 9)) for r in b} == {(r.doc_id, round(r.score, 9)) for r in c}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text", 4)], "doc_id long, text string, n_chars int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r) for r in q.classify(docs, none).collect()] == [(1, brute_held_out(1), 0.5, 1)]
    assert q.classify(docs.limit(0), none).collect() == []


def test_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'some text' AS text", "9 AS n_chars")
    labels = spark.range(4000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS label")
    assert 100 < q.feature_rows(docs, labels, max_train=200).count() < 300
    assert q.feature_rows(docs, labels, max_train=None).count() == 4000
