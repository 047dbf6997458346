"""Quality classifier: naive Bayes support vectors.

A text's features are indicators: hashed byte n-grams, and the lengths of runs of one repeated word.
Each indicator is scaled by the log ratio of its smoothed rates in the two classes; a linear model
with hinge loss is fitted to the scaled indicators by dual coordinate descent, and a logistic curve
on margins of texts left out of the fit turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.llm.common import table

#: Buckets of hashed features; the last RUNS are runs of a repeated word.
BUCKETS = 1 << 18
RUNS = 8
#: Labelled rows that a fit takes at most: those with the smallest hashes of their identifiers.
SAMPLE_ROWS = 4000
THRESHOLD = 0.7


def feature_rows(column: pa.Array, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    flags = np.zeros(buckets + RUNS, bool)
    shift = np.uint64(64 - (buckets - 1).bit_length())
    for _, _, data, offsets in textvec.chunks(column):
        wide = data.astype(np.uint64)
        two = ((wide[:-1] << np.uint64(8) | wide[1:]) + np.uint64(1 << 40)) * np.uint64(0x9E3779B97F4A7C15) >> shift
        three = (wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) * np.uint64(0x9E3779B97F4A7C15) >> shift
        hashes, first = textvec.words(data, offsets, lower=False)
        same = np.zeros(len(hashes), bool)
        same[1:] = hashes[1:] == hashes[:-1]
        same[first[:-1][first[:-1] < len(hashes)]] = False
        at = np.arange(len(hashes))
        run = at - np.maximum.accumulate(np.where(same, 0, at)) if len(hashes) else at
        for i in range(len(offsets) - 1):
            a, b = offsets[i], offsets[i + 1]
            flags[two[a : max(a, b - 1)]] = True
            flags[three[a : max(a, b - 2)]] = True
            longest = int(run[first[i] : first[i + 1]].max(initial=0))
            if longest:
                flags[buckets : buckets + min(RUNS, longest.bit_length())] = True
            found = np.flatnonzero(flags)
            flags[found] = False
            yield found


@dataclass
class NaiveBayesSVM:
    """weights holds ratio * coefficient of each feature; score = logistic(slope * margin + offset)."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) / np.sqrt(max(1, len(found))) + self.bias

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -50, 50)))


def _fit_linear(rows: list[np.ndarray], y: np.ndarray, size: int, cost: float, passes: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent on the hinge loss: one multiplier per text, kept in [0, cost]."""
    up, down = np.full(size, 1.0), np.full(size, 1.0)
    for found, label in zip(rows, y, strict=True):
        (up if label > 0 else down)[found] += 1
    ratio = np.log(up / up.sum()) - np.log(down / down.sum())
    values = [ratio[found] / np.sqrt(max(1, len(found))) for found in rows]
    norms = np.array([v @ v for v in values]) + 1.0
    share = max(1, (y > 0).sum()), max(1, (y < 0).sum())
    limit = np.where(y > 0, cost * len(y) / (2 * share[0]), cost * len(y) / (2 * share[1]))
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w * ratio, bias


def _fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with smoothed targets."""
    positives, negatives = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (positives + 1) / (positives + 2), 1 / (negatives + 2))
    slope, offset = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -50, 50)))
        d = p - target
        h = p * (1 - p) + 1e-9
        grad = np.array([d @ margins + 1e-3 * slope, d.sum()])
        hess = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return slope, offset


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int = BUCKETS + RUNS, cost: float = 1.0, passes: int = 12) -> NaiveBayesSVM:
    """Without rows of both classes the score is their smoothed share of label 1 (0.5 without rows)."""
    y = np.where(np.asarray(labels) > 0, 1, -1)
    if len(y) < 4 or abs(y.sum()) == len(y):
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return NaiveBayesSVM(np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(y))
    for part in range(2):
        out = np.arange(len(y)) % 2 == part
        inside = np.flatnonzero(~out)
        weights, bias = _fit_linear([rows[i] for i in inside], y[inside], size, cost, passes)
        half = NaiveBayesSVM(weights, bias, 1.0, 0.0)
        margins[out] = [half.margin(rows[i]) for i in np.flatnonzero(out)]
    slope, offset = _fit_curve(margins, y)
    weights, bias = _fit_linear(rows, y, size, cost, passes)
    return NaiveBayesSVM(weights.astype(np.float32), bias, slope, offset)


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most that many labelled documents outside the held-out fold, by identifier hash.

    Of conflicting labels of an identifier the larger counts, of its texts the smallest; null identifiers and labels are no labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(fold("doc_id", folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` ids: a proven bound for the broadcast
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).orderBy("doc_id").limit(rows)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label_col: str = "quality", folds: int = 4, held: int = 2) -> NaiveBayesSVM:
    """Fit on the bounded sample; its features, not its texts, reach the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.astype("<i4").tobytes() for x in feature_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "found"])

    sample = labelled_sample(docs, labels, label_col, folds, held, rows)
    got = sample.mapInArrow(features, "doc_id long, label int, found binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    return fit([np.frombuffer(bytes(r["found"]), "<i4") for r in got], np.array([r["label"] for r in got]))


def score_quality(docs: DataFrame, model: NaiveBayesSVM, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row; the whole text counts and nothing else.

    Null and empty texts have no features and get the score of the bias alone. Repeated rows give
    repeated results; no rows give none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            margins = np.array([model.margin(x) for x in feature_rows(batch.column(1), len(model.weights) - RUNS)])
            score = model.score(margins)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted. A null doc_id counts as not held out."""
    scored = score_quality(docs, fit_quality(docs, labels, rows))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the classifier rejects, all columns kept, whatever their names; null and empty texts count by their score."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, rows))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            margins = np.array([model.margin(x) for x in feature_rows(batch.column(at), len(model.weights) - RUNS)])
            yield batch.filter(pa.array(model.score(margins) >= threshold, pa.bool_()))

    # neutral names on the way: mapInArrow cannot read a column that has a dot in its name
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality of documents by labels.quality; odd rows as in score_quality."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
