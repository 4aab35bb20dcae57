"""Held-out accuracy, the descent against its optimum, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parley.llm import quality_classifier as qc


def test_held_out_accuracy_and_contract(spark, sf, labels):
    got = qc.op1_quality_classifier(spark, sf).cache()
    assert got.count() == 1000
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert rows and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.98
    assert got.where("predicted <> cast(score >= 0.3 as int) or score < 0 or score > 1 or score is null").count() == 0


def test_held_out_labels_are_not_read(spark, docs, labels):
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = qc.train(docs, labels), qc.train(docs, flipped)
    assert np.array_equal(a.weight, b.weight) and (a.slope, a.shift) == (b.slope, b.shift)


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5))
    y = np.sign(x[:, 0] + 0.3 * rng.normal(size=60))
    rows = [np.arange(5)] * 60
    cost = np.full(60, 0.7)
    w = qc.descend(rows, list(x), y, cost, 6, rounds=3000)
    value = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))).sum()
    best = value(w)
    assert all(value(w + 0.01 * rng.normal(size=6)) >= best - 1e-3 for _ in range(300))


def test_features_are_sets_of_whole_texts():
    ids, bounds = qc.slice_features(pa.array(["abcabc", "", "abc", "x y"]))
    parts = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert parts[1] == [] and all(len(p) == len(set(p)) for p in parts)
    alone = [qc.slice_features(pa.array([t]))[0].tolist() for t in ["abcabc", "", "abc", "x y"]]
    assert parts == alone


def test_odd_rows(spark, odd, labels, no_labels, no_docs, docs):
    from tests.llm.conftest import odd_rows

    model = qc.train(docs, labels)
    rows = qc.score(odd, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 300}) == 1
    kept = qc.keep_quality(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)
    assert qc.score(no_docs, model).count() == 0 and qc.keep_quality(no_docs, model).count() == 0
    none = qc.train(docs, no_labels)
    assert {r.score for r in qc.score(odd, none).collect()} == {0.5}
    assert qc.train(no_docs, labels).weight is None
    ones = qc.train(docs, labels.where("quality = 1"))
    assert {r.predicted for r in qc.score(odd, ones).collect()} == {1}
