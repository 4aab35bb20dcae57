"""Quality rules: fixed limits, then boosted trees over document statistics.

``document_stats`` adds counts of words, characters, symbols, repeated lines
and repeated three-word windows. ``fit_rules`` grows monotone-constrained trees
on a bounded sample of labelled rows; ``apply_rules`` gives the verdict.

Defined results: a null or empty text has zero counts and fails the limits; a
null doc_id stays null and its row is scored like any other; repeated rows give
repeated results; an empty table gives an empty result; without labels of both
kinds no trees are grown and only the fixed limits decide (score 1). Columns
of the input other than ``doc_id`` and ``text`` are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import text as tx
from parley.llm import trees
from parley.llm.sample import labelled_sample, sampled_texts

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios that the trees see, with the direction in which a growing value may move the verdict (0: free).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "punct_per_word": 0, "bang_per_word": -1, "bar_per_word": -1,
    "distinct_share": 0, "words_per_line": 0, "high_byte_share": 0, "same_as_last_share": -1, "stop_per_word": 0,
}
MONOTONE = np.array(list(FEATURES.values()))

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SAMPLE_ROWS = 20_000
THRESHOLD = 0.5

_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!\"'(),-./:;?")] = True


def slice_stats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of the texts of one slice, a row for each."""
    data, offsets = tx.raw(column)
    rows = len(offsets) - 1
    w = tx.Words(data, offsets)
    n_words = np.diff(w.bounds)
    points = (data & 0xC0) != 0x80
    count = lambda mask: tx.per_row(mask, offsets)
    word_chars = count(points & w.inside)
    symbols = count(SYMBOLS[data])
    h = w.hashes()

    at, grams = w.grams(h, 3)
    repeated = np.zeros(len(w) + 3, bool)
    if len(at):
        key = tx.mix(grams ^ (w.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        hit = at[times[back] > 1]
        for i in range(3):
            repeated[hit + i] = True
    spans = lambda mask: tx.per_row(mask, w.bounds)
    n_repeat = spans(repeated[: len(w)])

    dup_lines, lines = np.zeros(rows, np.int64), np.ones(rows, np.int64)
    whole = data.tobytes()
    for i in np.flatnonzero(count(data == 10)):
        real = [x for x in whole[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(b" \t\n\v\f\r")]
        dup_lines[i], lines[i] = len(real) - len(set(real)), max(1, len(real))

    same = np.zeros(len(w), bool)
    if len(w) > 1:
        same[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    distinct = np.zeros(rows, np.int64)
    if len(w):
        pair = np.unique(tx.mix(h ^ (w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
        distinct = np.bincount(w.row[pair], minlength=rows)

    of = lambda a, b: a / np.maximum(b, 1)
    features = np.stack([
        np.log1p(n_words), of(word_chars, n_words), of(symbols, n_words), of(dup_lines, lines), of(n_repeat, n_words),
        of(count(_UPPER[data]), word_chars), of(count(_DIGIT[data]), word_chars), of(count(_PUNCT[data]), n_words),
        of(count(data == 33), n_words), of(count(data == 124), n_words), of(distinct, n_words), of(n_words, lines),
        of(count(data >= 0x80), word_chars), of(spans(same), n_words), of(count(data == 46), n_words),
    ], 1).astype(np.float64)
    return np.stack([n_words, word_chars, symbols, dup_lines, n_repeat], 1), features


def _stats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = tx.filled(column)
    parts = [slice_stats(column.slice(a, b - a)) for a, b in tx.slices(column)]
    if not parts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts and ``features`` (array of the ratios in ``FEATURES``' order) of every text."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in COUNTS),
                           T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, features = _stats(b.column("text"))
            flat = pa.ListArray.from_arrays(np.arange(len(features) + 1, dtype=np.int32) * len(FEATURES), features.ravel())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in counts.T), flat], ["doc_id", *COUNTS, "features"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> trees.Forest | None:
    """Trees for P(quality = 1), fitted on at most ``sample_rows`` labelled rows; None without both labels."""
    sample = sampled_texts(docs, labelled_sample(labels, "quality", sample_rows, seed))
    label = sample.select("doc_id", "label").schema["label"]
    schema = T.StructType([label, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            features = _stats(b.column("text"))[1]
            flat = pa.ListArray.from_arrays(np.arange(len(features) + 1, dtype=np.int32) * len(FEATURES), features.ravel())
            yield pa.RecordBatch.from_arrays([b.column("label"), flat], ["label", "features"])

    got = sample.select("text", "label").mapInArrow(run, schema).toArrow()
    y = got.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = got.column("features").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order of arrival
    return trees.fit(x[order], y[order], MONOTONE)


def apply_rules(docs: DataFrame, forest: trees.Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the five counts, base_failed, score (1 without trees) and kept of every document."""
    schema = T.StructType([
        docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, features = _stats(b.column("text"))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            score = forest.score(features) if forest is not None else np.ones(len(features))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))],
                schema.fieldNames(),
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Query: counts, fixed limits and the trees' verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forest = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, forest).withColumn("score", F.round("score", 6))
