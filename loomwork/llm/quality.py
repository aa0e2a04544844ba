"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text is a bag of hashed features: word unigrams and bigrams, and unigrams, bigrams and trigrams of word forms (case,
digits, the marks a word ends with, whether it repeats the word before). A score is the logistic of a sparse dot
product with shares of the text's features as values, so whole texts of any length are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textkernel as K

BITS = 18
#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of their ids.
TRAIN_ROWS, EPOCHS = 12_000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.0001

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_KINDS = 5


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram, the hashed features and their rows' bounds."""
    starts, ends, first = K.word_bounds(data, offsets, K.SOLID)
    words = K.word_hashes(K.LOWER[data], starts, ends)
    n = len(words)
    if not n:
        return [(np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))] * _KINDS

    def many(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        return np.minimum(c[ends] - c[starts], 3)

    upper, digit, letter = many(_UPPER), many(_DIGIT), many(_LETTER)
    marks = np.minimum(many(~(_UPPER | _DIGIT | _LETTER)), 3)
    last = data[ends - 1]
    mark = np.where(_UPPER[last] | _DIGIT[last] | _LETTER[last], 0, last).astype(np.uint64)
    same = np.zeros(n, bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][first[:-1] < n]] = False
    form = (np.minimum(upper, 2) * 3 + np.minimum(letter, 2)) * 16 + np.minimum(digit, 1) * 8 + marks * 2 + same
    form = K.mix((form.astype(np.uint64) << np.uint64(8) | mark) + np.uint64(1))
    out = []
    for salt, (base, k) in enumerate(((words, 1), (words, 2), (form, 1), (form, 2), (form, 3))):
        grams = K.gram_hashes(base, k) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
        own = np.flatnonzero(np.repeat(first[1:], np.diff(first))[: len(grams)] - np.arange(len(grams)) >= k) if k > 1 else slice(None)
        grams = grams[own]
        bounds = first if k == 1 else np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - k + 1, 0))])
        out.append((((grams ^ (grams >> np.uint64(32))) & np.uint64((1 << BITS) - 1)).astype(np.int64), bounds))
    return out


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row; the last weight is the bias."""
    total = np.full(len(offsets) - 1, weights[-1])
    for index, bounds in features(data, offsets):
        total += K.sums(weights[index], bounds) / np.maximum(np.diff(bounds), 1)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by per-coordinate follow-the-regularised-leader over (features, values) rows; last the bias.

    The bias is the labels' log odds and isn't learnt, so a text that says little is scored as most texts are.
    """
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    good = (float(labels.sum()) + 1) / (len(labels) + 2)
    prior = float(np.log(good / (1 - good)))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)).tolist():
            at, x = rows[r]
            zs, ns = z[at], n[at]
            own = np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(own @ x + prior, -35, 35)))
            g = (p - labels[r]) * x
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            z[at] = zs + g - sigma * own
            n[at] = ns + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    w[-1] = prior
    return w


def _bags(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    kinds = features(data, offsets)
    for row in range(len(offsets) - 1):
        at, x = [], []
        for index, bounds in kinds:
            own = index[bounds[row] : bounds[row + 1]]
            if len(own):
                u, c = np.unique(own, return_counts=True)
                at.append(u)
                x.append(c / len(own))
        at = np.concatenate([np.zeros(0, np.int64), *at])
        x = np.concatenate([np.zeros(0), *x])
        u, back = np.unique(at, return_inverse=True)
        yield u, np.bincount(back, x, len(u))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task over the bounded sample (label, text): the weights as one row of bytes."""
    rows, labels = [], []
    for batch in batches:
        data, off = K.column_bytes(batch.column(1))
        labels += batch.column(0).to_pylist()
        for i, j in K.pieces(off):
            rows += [(u.astype(np.int32), x.astype(np.float32)) for u, x in _bags(data[off[i] : off[j]], off[i : j + 1] - off[i])]
    w = fit(rows, np.array(labels, np.float64)) if rows else np.zeros((1 << BITS) + 1)
    yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary())], ["weights"])


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from at most ``most`` labelled rows that aren't held out.

    Ids with a null or contradicting label, or without a document, teach nothing; without any row all scores are 0.5.
    """
    C.tune(docs.sparkSession)
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_q"))
    known = known.where((F.col("quality") == F.col("_q")) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded by ``most``, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").where("text is not null")
    # a repeated id would teach more than once: its first text by hash stays
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("quality", "text").mapInArrow(C.lean(_train), "weights binary").collect()
    return np.frombuffer(found[0][0], "<f4").astype(np.float64) if found else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text; further columns are ignored).

    Null and empty texts get the bias alone. Repeated rows score alike; an empty table gives an empty one.
    """
    C.tune(docs.sparkSession)
    own = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch_scores(batch.column(2), own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def batch_scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    data, off = K.column_bytes(texts)
    return np.concatenate([np.zeros(0), *(scores(data[off[i] : off[j]], off[i : j + 1] - off[i], weights) for i, j in K.pieces(off))])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that a model of ``labels`` gives 0.5 or more.

    Null and empty texts get what most labels say; repeated rows stay or go together; an empty table gives an empty
    one; without any label that teaches, all stay (0.5).
    """
    own, place = train(docs, labels).astype(np.float32), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(batch_scores(batch.column(place), own) >= 0.5))

    return C.batches_of(docs, run)
