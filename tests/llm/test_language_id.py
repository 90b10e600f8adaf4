"""Operator 6: held-out accuracy, counts against plain Python, edges."""

from collections import Counter

import numpy as np

from spanwise.llm import language_id as lid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_histogram_against_plain_counting(monkeypatch):
    text = "Hé, a b\n\n42 ab! " * 40
    clean = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "

    def slot(gram):
        key = 0
        for c in gram:
            key = (key * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
        return ((key + len(gram)) * 0x9E3779B1 & 0xFFFFFFFF) >> 17

    want = Counter(slot(clean[i : i + n]) for n in (1, 2, 3) for i in range(len(clean) - n + 1))
    got = lid._histogram(text)
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == want
    monkeypatch.setattr(lid, "CHUNK", 7)
    assert np.array_equal(lid._histogram(text), got)


def test_edges(spark):
    rows = [(i, f"the cat and dog {i}", "en") for i in range(60)] + [(100 + i, f"le chat est là {i}", "fr") for i in range(60)]
    rows += [(300, None, "en"), (301, "", "fr"), (302, "123 !?", "en"), (303, "the dog", None), (None, "le chat", "fr"), (304, "the " * 200_000, None), (303, "the dog", None)]
    df = spark.createDataFrame([(*r, "x", 0.5, True) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean")
    out = lid.identify(df).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[300] == by[301] == by[302] == [("und", 0.0)]
    assert [x[0] for x in by[303]] == ["en", "en"] and by[304][0][0] == "en" and by[None][0][0] == "fr"
    assert lid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in lid.identify(df.withColumn("lang", df.lang.substr(9, 1)).where("false")).collect()} == set()


def test_no_labels_and_bounded_training(spark):
    df = spark.createDataFrame([(i, "some text", None) for i in range(9)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in lid.identify(df).collect()} == {("und", 0.0)}
    many = spark.range(4000).selectExpr("id as key", "concat('alpha beta ', id) as text", "'en' as lang")
    model = lid.train(many, max_train=500)
    whole = lid.train(many, max_train=None)
    assert model.langs == whole.langs == ["en"]
