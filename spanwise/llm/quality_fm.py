"""Operator 12, quality classifier: a factorisation machine.

A text's features are its hashed words (WORD_BUCKETS, tf-weighted, of unit length), structure statistics
(lengths, shares of character kinds, repetition; in bins) and the metadata ``n_chars`` (in bins, one for null).  The score is
logistic in ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; with FACTORS columns in v the pairwise
term is ``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``, linear in the features present.

Learning: at most about MAX_TRAIN labelled documents (``max_train``, chosen by a hash of the id;
``None``: all) are turned into feature rows and stored; each of ROUNDS steps broadcasts the parameters (a
fixed size), sums the gradient over the rows on the executors and moves them by Adam.  Every document is
scored whole.

Defined results: null texts count as empty; an empty text is scored from its (empty) statistics; labels other
than 0 and 1, labels of null ids and labels without a document teach nothing; several labels of one id
teach their mean; without any label every score is 0.5.  Rows that repeat an id are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm.common import Tables, encode, pieces
from spanwise.llm.textgrams import Words, slices

WORD_BUCKETS = 1 << 14
BINS = 16
FACTORS = 8
MAX_TRAIN = 20_000
ROUNDS = 30
RATE = 0.05
DECAY = 1e-5  # of squared parameters
TASKS = 8  # partial gradients of a step, each of the parameters' size

_SPACE, _SENTENCE, _INNER, _SYMBOL, _DIGIT, _UPPER, _LOWER, _OTHER, _LINE = range(9)  # kinds of bytes
_KIND = np.full(256, _OTHER, dtype=np.int64)
_KIND[:128] = _SYMBOL
for _kind, _bytes in ((_SPACE, b" \t\v\f\r"), (_LINE, b"\n"), (_SENTENCE, b".!?"), (_INNER, b",;:'\"()-"), (_DIGIT, b"0123456789"),
                      (_UPPER, bytes(range(65, 91))), (_LOWER, bytes(range(97, 123)))):
    _KIND[list(_bytes)] = _kind
STATISTICS = 16
SIZE = WORD_BUCKETS + STATISTICS * BINS


def _log(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(x + 1.0), BINS - 1)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 to 1 spread over the bins, finer near 0."""
    return (BINS - 1) * np.sqrt(np.clip(part / np.maximum(whole, 1), 0.0, 1.0))


def features(texts: list[bytes], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, index, value): sparse feature rows of texts; ``n_chars``: float, NaN for null.  Every row has features."""
    out = [_features(texts[a:b], n_chars[a:b]) for a, b in slices(texts)]
    base = np.cumsum([0] + [len(i) for _, i, _ in out])
    return (np.concatenate([s + k for (s, _, _), k in zip(out, base, strict=False)]),
            np.concatenate([i for _, i, _ in out]), np.concatenate([x for _, _, x in out]))


def _features(texts: list[bytes], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(texts)
    words = Words(texts, punctuation=False)
    doc = np.repeat(np.arange(n), words.counts)
    key, count = np.unique(doc * WORD_BUCKETS + (words.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), return_counts=True)
    owner = key // WORD_BUCKETS
    weight = 1.0 + np.log(count)
    norm = np.sqrt(np.bincount(owner, weight**2, n))
    distinct = np.bincount(owner, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, owner, count)
    sizes = np.diff(words.offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * 9, sizes) + _KIND[words.buf], minlength=9 * n).reshape(n, 9)
    size, lines, total = sizes - 1, kinds[:, _LINE], words.counts
    length = words.ends - words.starts
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    chars = np.bincount(doc, length, n)
    mean = chars / np.maximum(total, 1)
    declared = np.where(np.isnan(n_chars), 0.0, np.maximum(np.nan_to_num(n_chars), 0.0))
    stats = np.stack([
        _log(total), _log(lines), np.minimum(mean, BINS - 1), np.minimum(np.log2(longest + 1.0) * 2, BINS - 1),
        np.minimum(total / lines, 128.0) / 128.0 * (BINS - 1), np.minimum(total / (kinds[:, _SENTENCE] + 1), 60.0) / 60.0 * (BINS - 1),
        _share(kinds[:, _SYMBOL], size), _share(kinds[:, _DIGIT], size), _share(kinds[:, _UPPER], size), _share(kinds[:, _OTHER], size),
        _share(kinds[:, _INNER], size), _share(kinds[:, _SENTENCE], size), _share(kinds[:, _SPACE], size),
        (BINS - 1) * distinct / np.maximum(total, 1), _share(most, total),
        np.where(np.isnan(n_chars), BINS - 1, np.minimum(_log(declared) * 0.75, BINS - 2)),
    ], axis=1)
    bins = WORD_BUCKETS + np.arange(STATISTICS) * BINS + np.clip(stats, 0, BINS - 1).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(distinct + STATISTICS)[:-1]))
    first = np.concatenate(([0], np.cumsum(distinct)[:-1]))
    index = np.empty(len(key) + n * STATISTICS, dtype=np.int32)
    value = np.empty(len(index), dtype=np.float32)
    at = np.arange(len(key)) - first[owner] + starts[owner] + STATISTICS
    index[at], value[at] = key % WORD_BUCKETS, weight / norm[owner]
    at = starts[:, None] + np.arange(STATISTICS)
    index[at], value[at] = bins, 1.0
    return starts, index, value


class Machine:
    """Parameters: ``bias``, ``linear`` (SIZE), ``factors`` (SIZE x FACTORS)."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    @classmethod
    def start(cls, seed: int = 1) -> Machine:
        return cls(0.0, np.zeros(SIZE), np.random.default_rng(seed).normal(0.0, 0.05, (SIZE, FACTORS)))

    def raw(self, starts: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score before the logistic function, the sums over features per factor, and v_i x_i."""
        each = self.factors[index] * value[:, None]
        sums = np.add.reduceat(each, starts, axis=0)
        squares = np.add.reduceat(each * each, starts, axis=0)
        line = np.add.reduceat(self.linear[index] * value, starts)
        return self.bias + line + 0.5 * (sums * sums - squares).sum(axis=1), sums, each

    def score(self, texts: list[bytes], n_chars: np.ndarray) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return logistic(self.raw(*features(texts, n_chars))[0])

    def gradient(self, starts, index, value, label) -> tuple[np.ndarray, np.ndarray]:
        """(SIZE x (FACTORS + 1) gradient of the log loss, summed; [bias gradient, rows])."""
        raw, sums, each = self.raw(starts, index, value)
        error = logistic(raw) - label
        row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(index))))
        push = error[row] * value
        back = push[:, None] * (sums[row] - each)
        grads = [np.bincount(index, x, SIZE) for x in (push, *back.T)]
        return np.stack(grads, axis=1), np.array([error.sum(), len(starts)])


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.clip(x, -60.0, 60.0)))


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def feature_rows(docs: DataFrame, labels: DataFrame, max_train: int | None = MAX_TRAIN) -> DataFrame:
    """(label, index, value) of the labelled documents to learn from; docs: (doc_id, text, n_chars), labels: (doc_id, label 0/1).

    The labels are cut to the bounded sample before the join, so no text of another document moves."""
    means = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.avg("label").alias("label"))
    n = means.count()
    if max_train is not None and n > max_train:
        means = means.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(max_train / n * (1 << 20)))
    if max_train is not None:
        means = F.broadcast(means)  # about max_train ids and numbers

    def make(batches):
        for batch in pieces(batches):
            starts, index, value = features(encode(batch.column("text")), numbers(batch.column("n_chars")))
            ends = np.append(starts[1:], len(index))
            yield pa.RecordBatch.from_arrays([
                batch.column("label"), pa.array([index[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                pa.array([value[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], ["label", "index", "value"])

    return docs.join(means, "doc_id").select("label", "text", "n_chars").mapInArrow(make, "label double, index binary, value binary")


def numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def train(rows: DataFrame, rounds: int = ROUNDS, tasks: int = TASKS) -> Machine | None:
    """Fit on stored feature rows; None without rows.  Each round is one job over the rows."""
    spark = rows.sparkSession
    spread = Tables(spark, "quality").store(rows.repartition(tasks), "rows")
    machine = Machine.start()
    params = np.concatenate((machine.linear[:, None], machine.factors), axis=1)
    bias, first, second = 0.0, np.zeros(params.size + 1), np.zeros(params.size + 1)
    for step in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(Machine(bias, params[:, 0], params[:, 1:]))

        def part(batches, shared=shared):
            total, ends = np.zeros((SIZE, FACTORS + 1)), np.zeros(2)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    b = batch.slice(at, 512)
                    index = [np.frombuffer(x, np.int32) for x in b.column("index").to_pylist()]
                    value = np.frombuffer(b"".join(b.column("value").to_pylist()), np.float32)
                    starts = np.cumsum([0] + [len(x) for x in index[:-1]])
                    g, e = shared.value.gradient(starts, np.concatenate(index), value, b.column("label").to_numpy())
                    total += g
                    ends += e
            if ends[1]:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([ends.tobytes()], pa.binary())], ["g", "e"])

        got = [(np.frombuffer(r["e"]), np.frombuffer(r["g"])) for r in spread.mapInArrow(part, "g binary, e binary").collect()]
        shared.destroy()
        if not got:
            return None
        n = sum(e[1] for e, _ in got)
        grad = np.append(sum(g for _, g in got) / n + DECAY * params.ravel(), sum(e[0] for e, _ in got) / n)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        params -= move[:-1].reshape(params.shape)
        bias -= move[-1]
    return Machine(bias, params[:, 0], params[:, 1:])


def scored(docs: DataFrame, machine: Machine | None, text_col: str = "text", chars_col: str = "n_chars", out_col: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of its whole text; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop(out_col)

    def run(batches):
        for batch in pieces(batches, text_col):
            if shared.value is None:
                got = np.full(batch.num_rows, 0.5)
            else:
                got = shared.value.score(encode(batch.column(text_col)), numbers(batch.column(chars_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
             label_col: str = "quality", max_train: int | None = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learned from labels that are not held out."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{chars_col}`").alias("n_chars"))
    taught = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where(~held_out())
    machine = train(feature_rows(base, taught, max_train))
    out = scored(base.select("doc_id", "text", "n_chars", held_out().alias("held_out")), machine)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
