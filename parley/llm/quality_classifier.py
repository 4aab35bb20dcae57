"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams (byte trigrams of the text; one to three consecutive word
shapes) are scaled by the log ratio of their smoothed class counts, each
document's vector is brought to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent. Margins become probabilities by a logistic
curve fitted on rows that the descent did not see.

The fit sees at most ``sample_rows`` labelled rows (a bounded, seeded sample);
scoring covers every whole text.

Defined results: a null or empty text has no n-grams and is scored by the bias
alone; a null doc_id is scored and is never held out; repeated rows get equal
scores; an empty table gives an empty result; without labels of both kinds every
score is the labels' only value (0.5 without any label). Only ``doc_id`` and
``text`` are read; ``keep_quality`` passes all other columns through unchanged,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import text as tx
from parley.llm.sample import fold, labelled_sample, sampled_texts

CHAR_BITS = 17
SHAPES = 1 << CHAR_BITS  # shape n-grams have the upper half of the feature range
WIDTH = 2 * SHAPES
SAMPLE_ROWS = 8_000
THRESHOLD = 0.3
HELD_OUT_FOLDS = 5

# classes of a byte: 0 space, 1 upper, 2 lower, 3 digit, 4 high, 5 stop, 6 comma, 7 mark, 8 symbol
_KIND = np.full(256, 8, np.uint8)
_KIND[[0x20, *range(9, 14)]] = 0
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[list(b".")], _KIND[list(b",;:")], _KIND[list(b"!?\"'()-")] = 5, 6, 7


def _shapes(w: tx.Words) -> np.ndarray:
    """A code for each word: classes of its first and last byte, capitals, digits, length, and whether it repeats the last word."""
    if not len(w):
        return np.zeros(0, np.uint64)
    data = w.data
    length = w.end - w.start
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    inside = lambda mask: (c := upto(mask))[w.end] - c[w.start]
    upper, digits = inside((data >= 65) & (data <= 90)), inside((data >= 48) & (data <= 57))
    same = np.zeros(len(w), bool)
    h = w.hashes()
    same[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    parts = [(_KIND[data[w.start]], 9), (_KIND[data[w.end - 1]], 9), ((upper > 1) & (2 * upper >= length), 2), (digits > 0, 2),
             (np.minimum(np.log2(length).astype(int), 5), 6), (same, 2)]
    code = np.zeros(len(w), np.int64)
    for value, size in parts:
        code = code * size + value
    return code.astype(np.uint64)


def slice_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, bounds): the distinct features of each text of a slice, row after row."""
    data, offsets = tx.raw(column)
    rows = len(offsets) - 1
    found = []
    if len(data) > 2:
        row = np.repeat(np.arange(rows), np.diff(offsets))
        whole = row[:-2] == row[2:]
        value = (data[:-2].astype(np.uint32) << np.uint32(16)) | (data[1:-1].astype(np.uint32) << np.uint32(8)) | data[2:]
        bucket = (value * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)
        found.append((row[:-2][whole] * WIDTH + bucket[whole]).astype(np.int64))
    w = tx.Words(data, offsets)
    shapes = _shapes(w)
    for n in (1, 2, 3):
        at, grams = w.grams(shapes, n)
        found.append(w.row[at] * WIDTH + SHAPES + (grams >> np.uint64(64 - CHAR_BITS)).astype(np.int64))
    codes = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes
    return (codes % WIDTH).astype(np.int32), np.searchsorted(codes, np.arange(rows + 1) * WIDTH)


@dataclass
class Model:
    weight: np.ndarray | None  # the hinge weights times the ratios; None: no fit was possible
    square: np.ndarray | None  # squared ratios, for the length of a document's vector
    bias: float
    slope: float
    shift: float

    def score(self, column: pa.Array) -> np.ndarray:
        column = tx.filled(column)
        if self.weight is None:
            return np.full(len(column), self.shift)
        out = [np.zeros(0)]
        for a, b in tx.slices(column):
            ids, bounds = slice_features(column.slice(a, b - a))
            out.append(_margin(ids, bounds, self.weight, self.square, self.bias))
        return 1 / (1 + np.exp(-np.clip(self.slope * np.concatenate(out) + self.shift, -35, 35)))


def _margin(ids, bounds, weight, square, bias):
    total = lambda v: (c := np.concatenate([[0.0], np.cumsum(v[ids], dtype=np.float64)]))[bounds[1:]] - c[bounds[:-1]]
    return total(weight) / np.sqrt(np.maximum(total(square), 1e-12)) + bias


def descend(rows: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, cost: np.ndarray, width: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Hinge-loss weights by dual coordinate descent: each step solves one row's dual variable in closed form.

    ``rows``/``x``: a row's feature ids and values; the last of ``width`` weights is the bias.
    """
    w, alpha = np.zeros(width), np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in x])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ x[i] + w[-1]) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                w[rows[i]] += step * y[i] * x[i]
                w[-1] += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def fit(rows: list[np.ndarray], y: np.ndarray, seed: int = 3) -> Model:
    """The model of bounded training rows (feature ids of each row, 0/1 labels)."""
    if not len(y) or y.min() == y.max():
        return Model(None, None, 0.0, 0.0, float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    test = np.zeros(len(y), bool)
    for label in (0, 1):  # a fifth of each class sets the curve
        own = np.flatnonzero(y == label)
        test[rng.permutation(own)[: len(own) // 5]] = True
    train = np.flatnonzero(~test)
    counts = [np.ones(WIDTH), np.ones(WIDTH)]
    for i in train:
        counts[y[i]][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    length = lambda ids: np.sqrt(max(float((ratio[ids] ** 2).sum()), 1e-12))
    x = [ratio[rows[i]] / length(rows[i]) for i in train]
    share = y[train].mean()
    cost = np.where(y[train] == 1, 0.5 / share, 0.5 / (1 - share))
    w = descend([rows[i] for i in train], x, 2.0 * y[train] - 1, cost, WIDTH + 1)
    weight, square = w[:-1] * ratio, ratio**2
    held = np.flatnonzero(test) if test.any() else train
    margin = np.array([(weight[rows[i]].sum() / length(rows[i])) + w[-1] for i in held])
    slope, shift = _curve(margin, y[held].astype(float))
    return Model(weight.astype(np.float32), square.astype(np.float32), float(w[-1]), slope, shift)


def _curve(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), with smoothed targets, by Newton steps."""
    pos = y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margin + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margin) @ margin + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(max(a, 0.1)), float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 11, folds: int = HELD_OUT_FOLDS) -> Model:
    """Fit on at most ``rows`` labelled rows outside fold 0 of crc32(doc_id)."""
    sample = sampled_texts(docs, labelled_sample(labels.where(fold("doc_id", folds) != 0), "quality", rows, seed))
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tx.filled(batch.column("text"))
            for a, b in tx.slices(column):
                ids, bounds = slice_features(column.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], ["label", "ids"])

    got = sample.select("label", "text").mapInArrow(run, schema).toArrow()
    y = got.column("label").to_numpy().astype(int)
    ids = got.column("ids").combine_chunks()
    flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py() if len(ids) else [0]
    vectors = [flat[at[i] : at[i + 1]] for i in range(len(y))]
    order = sorted(range(len(y)), key=lambda i: (y[i], len(vectors[i]), vectors[i].tobytes()))  # whatever the order of arrival
    return fit([vectors[i] for i in order], y[order])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 x WIDTH float32, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.score(b.column("text")))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("score", F.round("score", 6))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: str | Column = "doc_id", folds: int = HELD_OUT_FOLDS) -> Column:
    return F.coalesce(fold(doc_id, folds) == 0, F.lit(False))


def keep_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.round(sent.value.score(b.column("text")), 6) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Query: the score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
