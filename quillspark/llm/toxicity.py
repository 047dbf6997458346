"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of those of its hash bucket and of its prefix's bucket. Filters of
several widths slide over the words, each filter's maximum over the text is kept, and a logistic
layer joins the maxima. The embeddings' first coordinate starts from smoothed class log ratios, the
rest at random; minibatches with Adam train all of it. Languages are told apart by function words in
the text, and each has its own offset, so that a score of 0.5 is its calibrated threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import textvec
from quillspark.llm.common import table
from quillspark.llm.quality import fold, labelled_sample

BUCKETS = 1 << 16
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Bytes of a word's prefix.
PREFIX = 4
SAMPLE_ROWS = 6000
EPOCHS = 6
THRESHOLD = 0.5
#: Words that scoring holds at once; longer texts are read window by window, with overlap.
WINDOW_WORDS = 4000

# fixed values: frequent function words of each language
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on are this be by from not at".split(),
    "fr": "le la les et des est un une dans que qui pour pas sur au avec par ce du".split(),
    "de": "der die das und ist nicht ein eine zu den von mit sich auf für dem des im auch".split(),
    "es": "el los las y del que en un una por con para su al como más lo se no".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int32) % BUCKETS


def _word_hash(word: str) -> int:
    return int(textvec.words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), letters=True)[0][0])


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((_word_hash(w), i) for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws)
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])


_KNOWN, _OF = _language_table()


def token_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(word buckets, prefix buckets, language number) of each text; words are runs of letters and digits."""
    for _, _, data, offsets in textvec.chunks(column):
        hashes, heads, first = textvec.words(data, offsets, letters=True, prefix=PREFIX)
        word, head = _bucket(hashes), _bucket(heads)
        at = np.minimum(np.searchsorted(_KNOWN, hashes), len(_KNOWN) - 1)
        known = np.where(_KNOWN[at] == hashes, _OF[at], -1)
        for i in range(len(offsets) - 1):
            a, b = first[i], first[i + 1]
            votes = np.bincount(known[a:b][known[a:b] >= 0], minlength=len(FUNCTION_WORDS))
            yield word[a:b], head[a:b], int(votes.argmax()) if votes.any() else len(FUNCTION_WORDS)


@dataclass
class TextCNN:
    words: np.ndarray
    heads: np.ndarray
    filters: dict[int, np.ndarray]  # width: [width, DIM, FILTERS]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    offsets: np.ndarray  # per language
    slope: float = 1.0

    def embed(self, word: np.ndarray, head: np.ndarray) -> np.ndarray:
        return self.words[word] + self.heads[head]

    def pool(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of all filters over the text, at least 0, and the positions they come from (-1: none)."""
        best, where = [], []
        for width in self.filters:
            n = len(x) - width + 1
            if n < 1:
                best.append(np.zeros(FILTERS, np.float32))
                where.append(np.full(FILTERS, -1))
                continue
            r = sum(x[o : o + n] @ self.filters[width][o] for o in range(width)) + self.biases[width]
            at = r.argmax(0)
            top = r[at, np.arange(FILTERS)]
            best.append(np.maximum(top, 0))
            where.append(np.where(top > 0, at, -1))
        return np.concatenate(best), where

    def pooled(self, word: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Maxima over a text of any length, window by window with overlap."""
        step, reach = WINDOW_WORDS, max(self.filters) - 1
        parts = [self.pool(self.embed(word[a : a + step + reach], head[a : a + step + reach]))[0] for a in range(0, max(1, len(word)), step)]
        return np.max(parts, axis=0)

    def logit(self, word: np.ndarray, head: np.ndarray) -> float:
        return float(self.pooled(word, head) @ self.out + self.out_bias)

    def score(self, logits: np.ndarray, language: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offsets[language], -50, 50)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad**2
        value[at] -= self.rate * m[at] / (1 - 0.9**self.t) / (np.sqrt(v[at] / (1 - 0.99**self.t)) + 1e-6)


def _log_ratios(ids: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of the shares of texts that have a bucket, shrunk for rare ones."""
    has = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for row, label in zip(ids, y, strict=True):
        has[int(label)][np.unique(row)] += 1
    n = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    return np.log((has[1] + 0.5) / (n[1] + 1)) - np.log((has[0] + 0.5 * n[0] / n[1]) / (n[0] + n[0] / n[1]))


def train(texts: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> TextCNN:
    """Without texts of both classes the score is the smoothed share of label 1 (0.5 without texts)."""
    rng = np.random.default_rng(seed)
    y = (np.asarray(labels) > 0).astype(int)
    f32 = np.float32
    model = TextCNN(
        rng.normal(0, 0.05, (BUCKETS, DIM)).astype(f32), rng.normal(0, 0.05, (BUCKETS, DIM)).astype(f32),
        {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(f32) for w in WIDTHS}, {w: np.zeros(FILTERS, f32) for w in WIDTHS},
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(f32), 0.0, np.zeros(len(LANGUAGES)),
    )
    if len(y) < 4 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        model.out[:], model.offsets[:] = 0, np.log(share / (1 - share))
        return model
    fresh = np.arange(len(y)) % 5 == 0  # left out of training, for calibration
    inside = np.flatnonzero(~fresh)
    ratio = _log_ratios([texts[i][0] for i in inside], y[inside])
    model.words[:, 0] = 0.3 * ratio
    model.heads[:, 0] = 0.1 * _log_ratios([texts[i][1] for i in inside], y[inside])
    for w in WIDTHS:
        model.filters[w][:, 0, : FILTERS // 2] = np.abs(model.filters[w][:, 0, : FILTERS // 2])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    adam = _Adam(0.01)
    bias = np.zeros(1, f32)
    for _ in range(epochs):
        order = rng.permutation(inside)
        for at in range(0, len(order), 32):
            adam.t += 1
            g_out, g_bias = np.zeros_like(model.out), np.zeros(1, f32)
            g_f = {w: np.zeros_like(v) for w, v in model.filters.items()}
            g_b = {w: np.zeros_like(v) for w, v in model.biases.items()}
            word_rows, head_rows, row_grads = [], [], []
            batch = order[at : at + 32]
            for i in batch:
                word, head, _ = texts[i]
                x = model.embed(word, head)  # of the whole text, however long
                top, where = model.pool(x)
                p = 1 / (1 + np.exp(-np.clip(top @ model.out + bias[0], -30, 30)))
                d = f32((p - y[i]) * weight[i] / len(batch))
                g_out += d * top
                g_bias += d
                back = d * model.out
                for k, w in enumerate(model.filters):
                    for f in np.flatnonzero(where[k] >= 0):
                        t, g = where[k][f], back[k * FILTERS + f]
                        g_f[w][:, :, f] += g * x[t : t + w]
                        g_b[w][f] += g
                        word_rows.append(word[t : t + w])
                        head_rows.append(head[t : t + w])
                        row_grads.append(g * model.filters[w][:, :, f])
            adam.step("out", model.out, g_out + 1e-4 * model.out)
            adam.step("bias", bias, g_bias)
            for w in model.filters:
                adam.step(f"f{w}", model.filters[w], g_f[w] + 1e-4 * model.filters[w])
                adam.step(f"b{w}", model.biases[w], g_b[w])
            if row_grads:
                grads = np.concatenate(row_grads)
                for name, value, rows in (("words", model.words, word_rows), ("heads", model.heads, head_rows)):
                    unique, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                    total = np.zeros((len(unique), DIM), f32)
                    np.add.at(total, inverse, grads)
                    adam.step(name, value, total, unique)
    model.out_bias = float(bias[0])
    _calibrate(model, texts, y, np.flatnonzero(fresh))
    return model


def _calibrate(model: TextCNN, texts: list, y: np.ndarray, fresh: np.ndarray) -> None:
    """Per language the cut between the classes that errs least on fresh texts, shrunk to the cut over all languages."""
    logits = np.array([model.logit(texts[i][0], texts[i][1]) for i in fresh])
    language, truth = np.array([texts[i][2] for i in fresh]), y[fresh]

    def cut(mask: np.ndarray, common: float | None) -> float:
        z, t = logits[mask], truth[mask]
        if t.sum() < 5 or (1 - t).sum() < 5:
            return 0.0 if common is None else common
        order = np.sort(z)
        tries = np.concatenate(([order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]))
        errors = np.array([((z >= c) != t).sum() for c in tries])
        best = tries[errors == errors.min()]
        return float((best.min() + best.max()) / 2)

    common = cut(np.ones(len(fresh), bool), None)
    for i in range(len(LANGUAGES)):
        mine = cut(language == i, common)
        weight = (language == i).sum() / ((language == i).sum() + 50)
        model.offsets[i] = -model.slope * (weight * mine + (1 - weight) * common)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label_col: str = "toxic", folds: int = 5, held: int = 0) -> TextCNN:
    """Train on the bounded sample; its bucket numbers, not its texts, reach the driver."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(token_rows(batch.column(1)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([w.astype("<i4").tobytes() for w, _, _ in found], pa.binary()),
                pa.array([h.astype("<i4").tobytes() for _, h, _ in found], pa.binary()), pa.array([x for _, _, x in found], pa.int32()),
            ], ["doc_id", "label", "words", "heads", "language"])

    sample = labelled_sample(docs, labels, label_col, folds, held, rows)
    got = sample.mapInArrow(features, "doc_id long, label int, words binary, heads binary, language int").collect()
    got.sort(key=lambda r: r["doc_id"])
    texts = [(np.frombuffer(bytes(r["words"]), "<i4"), np.frombuffer(bytes(r["heads"]), "<i4"), r["language"]) for r in got]
    return train(texts, np.array([r["label"] for r in got]))


def score_toxicity(docs: DataFrame, model: TextCNN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, language (as read from the text), score, predicted of every row; whole texts count.

    Null and empty texts have no words and get the score of the biases. Repeated rows give repeated
    results; no rows give none; other columns, a language column too, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = [(model.logit(w, h), x) for w, h, x in token_rows(batch.column(1))]
            language = np.array([x for _, x in rows], int)
            score = model.score(np.array([z for z, _ in rows], float), language)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([LANGUAGES[i] for i in language], pa.string()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "language", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, language string, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of documents by labels.toxic; a null doc_id counts as not held out, odd rows as in score_toxicity."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "language", "score", "predicted")
