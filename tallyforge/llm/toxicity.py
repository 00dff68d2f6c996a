"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A word is a run of letters and digits, lower-cased where it is ASCII. A text's features are the presence of its words,
of its pairs of neighbouring words and of its pairs with one word between (skip-grams), hashed to 2**BITS places.
Training is FTRL-proximal: each coordinate has its own learning rate, from the gradients it has seen, and L1 keeps
coordinates at zero until they have earned a weight, so that the model is a short list of (place, weight), whose size
2**BITS bounds, and is broadcast. It learns from at most MOST_ROWS labelled rows that are not held out (those with the
smallest hash of their id), one text an id, in one task behind a shuffle, so that texts are read by all tasks; that bound is the only sample. Scoring covers every whole text, in one pass.

Nulls, ties, empties: null and empty texts have no features and score by the intercept; labelled rows without a label or a
document are not used, a document labelled more than once counts once, with its largest label, and an id with several texts teaches its smallest one; repeated rows get equal scores; with no
labels at all every score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import LETTERS, LOWER, bounded, buffers, mixed, prefix_sums, slices, span_hashes, text_or_empty, words_of

BITS, MOST_ROWS, EPOCHS, THRESHOLD = 20, 16_384, 6, 0.7
#: FTRL-proximal: learning rate, its smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every n-gram and skip-gram of some rows' texts; repeats are left in."""
    data = LOWER[data]
    starts, ends, upto = words_of(data, offsets, LETTERS)
    word = span_hashes(prefix_sums(data), starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(upto))
    rows, places = [row], [word]
    for gap, seed in ((1, 0x9E6C63D0676A9A99), (2, 0xC2B2AE3D27D4EB4F)):
        same = row[:-gap] == row[gap:]
        rows.append(row[:-gap][same])
        places.append(mixed(word[:-gap][same] * np.uint64(seed) + word[gap:][same]))
    return np.concatenate(rows), np.concatenate(places) >> np.uint64(64 - bits)


def learn(texts: list[tuple[np.ndarray, float]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (places, label) rows, in order: weights by place, and the intercept (never held at zero)."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    l1 = np.full(len(z), L1)
    l1[-1] = 0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        size = np.abs(z[at]) - l1[at]
        return np.where(size > 0, -np.sign(z[at]) * size / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for places, label in texts:
            at = np.append(places, len(z) - 1)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], float(w[-1])


def held_out(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1


#: A model of one class: the places that have a weight, their weights, and the intercept.
Model = tuple[np.ndarray, np.ndarray, float]


def trained(docs: DataFrame, labels: DataFrame, classes: list[Column], most_rows: int = MOST_ROWS) -> list[Model]:
    """A model for each of some 0/1 columns of the labels, from one bounded sample."""
    ys = [f"y{k}" for k in range(len(classes))]
    known = labels.filter(F.col("doc_id").isNotNull()).filter(~held_out()).select("doc_id", *[c.cast("double").alias(y) for c, y in zip(classes, ys, strict=True)]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")  # most_rows bounds it
    rows = rows.groupBy("doc_id", *ys).agg(F.min("text").alias("text"))  # one row an id, however often it is repeated
    bounded(docs.sparkSession)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = []
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for i, row in enumerate(zip(*(batch[c].to_pylist() for c in ("doc_id", *ys)), strict=True)):
                _, places = features(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i])
                key = int(mixed(np.array([row[0] & (2**64 - 1)], np.uint64))[0])
                texts.append((key, *row, np.unique(places).astype(np.int32)))
        texts.sort(key=lambda t: t[:-1])  # the same model however the rows came in
        for k in range(len(ys)):
            w, b = learn([(t[-1], t[2 + k]) for t in texts])
            at = np.flatnonzero(w)
            yield pa.record_batch([pa.array(np.full(len(at) + 1, k), pa.int32()), pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], b), pa.float64())], ["k", "place", "weight"])

    found = rows.repartition(1).mapInArrow(fit, "k int, place long, weight double").toArrow()
    of, places, weights = (found[c].to_numpy() for c in ("k", "place", "weight"))
    return [(places[(of == k) & (places >= 0)], weights[(of == k) & (places >= 0)], float(weights[(of == k) & (places < 0)].sum())) for k in range(len(ys))]


def margins(texts: pa.Array, models: list[Model]) -> np.ndarray:
    """Texts x models: the intercept and the weights of a text's features, added up."""
    tables = np.zeros((len(models), 1 << BITS), np.float32)
    for table, (places, weights, _) in zip(tables, models, strict=True):
        table[places] = weights
    any_weight = (tables != 0).any(0)
    data, offsets = buffers(texts)
    out = np.tile([m[2] for m in models], (len(offsets) - 1, 1))
    for i, j in slices(offsets, 1 << 20):
        row, place = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hit = np.flatnonzero(any_weight[place])
        pair = np.unique(row[hit].astype(np.int64) << BITS | place[hit].astype(np.int64))  # presence
        for k, table in enumerate(tables):
            np.add.at(out[:, k], i + (pair >> BITS), table[pair & ((1 << BITS) - 1)])
    return np.clip(out, -35, 35)


def scorer(docs: DataFrame, labels: DataFrame) -> Callable[[Column], Column]:
    """text column -> score column."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, [F.col("toxic")]))

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-margins(texts, shared.value)[:, 0])))

    return F.arrow_udf(score, "double")


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows = docs.select("doc_id", scorer(docs, labels)(text_or_empty()).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose texts are not scored as toxic."""
    return docs.filter(scorer(docs, labels)(text_or_empty()) < threshold)
