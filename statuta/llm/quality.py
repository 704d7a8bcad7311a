"""Operator 5, quality classifier: Bradley-Terry pairwise ranking.

A document of label 1 is preferred to one of label 0. With score s = w·f of a document's features f,
the model says P(a preferred to b) = 1 / (1 + exp(-(s_a - s_b))), so w is learnt by logistic loss on
feature differences of preference pairs. The cut is the quantile of the scores of all labelled
documents that matches the share of label 0; scores are mapped so that the cut is 0.7.

Features come from the text alone. The weights are fit on at most `fit_rows` labelled documents (those of
the smallest hash of doc_id) and `pairs_each` pairs for each; both bound what reaches the driver. The
features and scores of all documents stay on the executors, and the cut is taken there.

Null text: the empty text, scored like any other. A label row whose quality is null, and documents
whose label rows disagree, teach nothing. Without documents of both labels every score is 0.7.
Repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import corpus, cut, hash_spans, mix, of_ids, row_sums, slices, table, utf8, words

CUT = 0.7
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~!/[]"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWERCASE = np.zeros(256, bool)
_LOWERCASE[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?"]] = True


def _distinct(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many different values each row has."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    if not len(values):
        return np.zeros(len(offsets) - 1)
    _, first = np.unique(values ^ mix(row + np.uint64(1)), return_index=True)
    return np.bincount(row[first].astype(np.int64), minlength=len(offsets) - 1).astype(float)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text."""
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    starts, ends, at = words(data, offsets)
    n = np.diff(at).astype(float)
    some_words = np.maximum(n, 1)
    hashes = hash_spans(data, starts, ends)
    share = lambda kind: row_sums(kind[data], offsets) / some
    letters = np.maximum(row_sums((_UPPER | _LOWERCASE)[data], offsets), 1)
    upper = row_sums(_UPPER[data], offsets) / letters
    symbol, digit, stop = share(_SYMBOL), share(_DIGIT), share(_STOP)
    length = (ends - starts).astype(float)
    mean = row_sums(length, at) / some_words
    bare = row_sums((length == 1) & _SYMBOL[data[starts]], at) / some_words if len(starts) else np.zeros(len(n))
    tailed = row_sums(_SYMBOL[data[ends - 1]], at) / some_words if len(starts) else np.zeros(len(n))
    different = _distinct(hashes, at) / some_words
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) else hashes
    pair_at = np.minimum(at, len(pairs))
    repeats = 1 - _distinct(pairs, pair_at) / np.maximum(np.diff(pair_at), 1)
    twice = row_sums(np.concatenate((hashes[1:] == hashes[:-1], [False]))[: len(hashes)], at) / some_words
    lines = np.ones(256, bool)
    lines[10] = False
    line_start, line_end, line_at = words(data, offsets, lines)
    n_lines = np.diff(line_at).astype(float)
    line_repeats = 1 - _distinct(hash_spans(data, line_start, line_end), line_at) / np.maximum(n_lines, 1)
    line_repeats[n_lines == 0] = 0
    repeats[np.diff(pair_at) == 0] = 0
    out = [
        np.log1p(n) / 10, np.log1p(n_lines) / 10, np.log1p(n / np.maximum(n_lines, 1)) / 10, (n < 5).astype(float),
        mean / 10, np.minimum(1, np.abs(mean - 5) / 10), upper, np.minimum(1, 5 * upper), (upper > 0.5).astype(float),
        symbol, np.sqrt(symbol), np.minimum(1, 20 * symbol), digit, np.minimum(1, 10 * digit), stop, np.minimum(1, 30 * stop),
        bare, np.minimum(1, 5 * bare), tailed, np.minimum(1, 5 * tailed), different, different * np.log1p(n) / 10,
        repeats, np.minimum(1, 3 * repeats), line_repeats, np.minimum(1, 3 * line_repeats),
        twice, np.minimum(1, 5 * twice),
    ]
    return np.stack(out, 1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = features(*utf8(part.column("text")))
        yield pa.record_batch({"doc_id": part.column("doc_id"), "f": pa.array(list(rows), pa.list_(pa.float64()))})


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, f array<double>) of every document."""
    return corpus(docs).mapInArrow(_measure, "doc_id long, f array<double>")


def bradley_terry(better: np.ndarray, worse: np.ndarray, pairs_each: int = 8, ridge: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of the features under which rows of `better` beat rows of `worse`: Newton's method on
    the logistic loss of the differences of drawn pairs."""
    draw = np.random.default_rng(seed)
    n = pairs_each * max(len(better), len(worse))
    left = np.resize(draw.permutation(len(better)), n)
    right = np.resize(draw.permutation(len(worse)), n)
    x = better[left] - worse[draw.permutation(right)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))  # the chance of the wrong order
        gradient = x.T @ p / n - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / n + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def clear_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the documents whose label rows agree. labels: (doc_id, quality)."""
    sure = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return sure.agg(F.min("quality").alias("y"), F.max("quality").alias("high")).where("y = high").select("doc_id", "y")


def fit(measures: DataFrame, clear: DataFrame, fit_rows: int = 20_000, pairs_each: int = 8) -> np.ndarray:
    """Weights of the features; none without documents of both labels."""
    sample = clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = measures.join(sample, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("f").alias("f")).collect()  # fit_rows at most
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.y for r in rows])
    if not len(y) or y.min() == y.max():
        return np.zeros(0)
    x = np.array([r.f for r in rows])
    return bradley_terry(x[y == 1], x[y == 0], pairs_each)


def weighed(w: np.ndarray) -> Column:
    s = F.lit(0.0)
    for i, weight in enumerate(w):
        s = s + F.col("f")[i] * float(weight)
    return s


def quantile_cut(measures: DataFrame, clear: DataFrame, w: np.ndarray) -> float:
    """Between the two scores of all labelled documents that part them in the proportion of the labels. The
    quantiles are good to a 100,000th of the documents."""
    known = measures.select("doc_id", weighed(w).alias("s")).join(clear, "doc_id")
    n, bad = known.agg(F.count("*"), F.count_if(F.col("y") == 0)).first()
    low, high = known.agg(F.percentile_approx("s", [(bad - 0.5) / n, min((bad + 0.5) / n, 1.0)], 100_000)).first()[0]
    return (low + high) / 2


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """doc_id, score and predicted (1 from 0.7 on) of every document."""
    measures, clear = cut(measured(docs)), clear_labels(labels)
    w = fit(measures, clear, fit_rows)
    score = F.lit(CUT)
    if len(w):
        score = 1 / (1 + F.exp(-(weighed(w) - quantile_cut(measures, clear, w) + float(np.log(CUT / (1 - CUT))))))
    return measures.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    out = classify(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go. Rows of one id stay if one of them is good, and
    so do those without one."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    return of_ids(docs, classify(docs, labels).where("predicted = 1"))
