"""Operator 6, language ID: multinomial naive Bayes over hashed character n-grams.

Features are runs of 1 to ORDER characters of the lower-cased text, every run of non-letters taken
as one space, hashed into BUCKETS.  Training counts (language, bucket) in Spark; the log-probability
matrix (BUCKETS x languages, a fixed size) is broadcast, and each text is scored whole: its sparse
counts times the matrix, in numpy.

Training takes at most about MAX_TRAIN labelled documents of each language, chosen by a hash of the
id (MAX_TRAIN is a parameter; ``None`` trains on all).  Prediction covers every document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import pieces

ORDER = 3
BUCKETS = 1 << 15
MAX_TRAIN = 20_000
ALPHA = 0.5
CHUNK = 1 << 20  # characters counted at a time
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _histogram(text: str) -> np.ndarray:
    """Counts of the text's hashed character n-grams, orders 1 to ORDER."""
    clean = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint32)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, len(codes), CHUNK):
        part = codes[start : start + CHUNK + ORDER - 1]
        key = np.zeros(len(part), dtype=np.uint32)
        for order in range(1, ORDER + 1):
            m = min(len(part) - order + 1, CHUNK)
            if m <= 0:
                break
            key = (key[: len(part) - order + 1] * np.uint32(0x01000193)) ^ part[order - 1 :]
            mixed = (key[:m] + np.uint32(order)) * np.uint32(0x9E3779B1)
            total += np.bincount(mixed >> np.uint32(17), minlength=BUCKETS)
    return total


class Model:
    """Languages in order, and the matrix of log-probabilities (BUCKETS x languages), and priors."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray):
        self.langs = langs
        smooth = counts + ALPHA
        self.matrix = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        self.prior = np.log(docs / docs.sum()) if len(langs) else np.zeros(0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Best language (ties: the first in order) and its posterior; ('und', 0) without a letter."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        counts = _histogram(text)
        at = np.flatnonzero(counts)
        score = counts[at].astype(np.float64) @ self.matrix[at] + self.prior
        best = int(np.argmax(score))
        return self.langs[best], float(1.0 / np.exp(score - score[best]).sum())


def train(rows: DataFrame, max_train: int | None = MAX_TRAIN) -> Model:
    """Fit on (text, lang, key) rows; key: an integer column that chooses the sample.

    Rows with a null text or lang teach nothing.  The result is BUCKETS x languages counts, summed on
    the executors.
    """
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    langs = list(sizes)
    share = F.lit(1.0)
    if max_train is not None:
        for lang, n in sizes.items():
            if n > max_train:
                share = F.when(F.col("lang") == lang, F.lit(max_train / n)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang")

    def count(batches):
        sums = {x: [0, np.zeros(BUCKETS, dtype=np.int64)] for x in langs}
        for batch in pieces(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if has_letter(text):
                    sums[lang][0] += 1
                    sums[lang][1] += _histogram(text)
        for lang, (n, counts) in sums.items():
            if n:
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], n), pa.int64())], ["lang", "bucket", "n"])

    table = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    known = sorted(set(table["lang"]))
    counts, docs = np.zeros((BUCKETS, len(known))), np.zeros(len(known))
    for k, lang in enumerate(known):
        part = table[table["lang"] == lang]
        docs[k] = part.loc[part["bucket"] < 0, "n"].sum()
        part = part[part["bucket"] >= 0]
        counts[part["bucket"].to_numpy(), k] = part["n"].to_numpy()
    return Model(known, counts, docs)


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); columns of those names are replaced.

    Only the text is read: null texts and texts without a letter get 'und' and 0; the rest the
    language of the highest posterior, over whole texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    # called non-deterministic, or a filter on the result is pushed below the column and predicts every text a second time,
    # in Python processes of its own
    out = docs.drop("lang_pred", "score").withColumn("__p", predict.asNondeterministic()(F.col(f"`{text_col}`")))
    return out.withColumns({"lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score")}).drop("__p")


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learned from rows that are not held out."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    model = train(base.where(~held_out()).select("text", "lang", F.col("doc_id").alias("key")))
    return predicted(base.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
