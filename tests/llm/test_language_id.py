"""Forward-backward against enumeration, held-out accuracy, code-switched text, odd rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import language_id as li


def enumerated(emission, transition, initial):
    n, width = emission.shape
    total = np.zeros((n, width))
    for path in itertools.product(range(width), repeat=n):
        s = initial[path[0]] + emission[range(n), path].sum() + sum(transition[a, b] for a, b in zip(path, path[1:]))
        for i, t in enumerate(path):
            total[i, t] += np.exp(s)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_marginals_equal_enumeration(block):
    rng = np.random.default_rng(block)
    sizes = [4, 0, 1, 6, 2]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    emission, move, initial = rng.normal(0, 2, (13, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    got = li.forward_backward(emission, bounds, move, initial, block)
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            assert np.allclose(got[a:b], enumerated(emission[a:b], move, initial))


def test_pairs_equal_enumeration():
    rng = np.random.default_rng(5)
    emission, move, initial = rng.normal(0, 2, (5, 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    want, mass = np.zeros((3, 3)), 0
    for path in itertools.product(range(3), repeat=5):
        p = np.exp(initial[path[0]] + emission[range(5), path].sum() + sum(move[a, b] for a, b in zip(path, path[1:])))
        mass += p
        for a, b in zip(path, path[1:]):
            want[a, b] += p
    got = li.pair_marginals(emission, np.array([0, 5]), move, initial, np.arange(1, 5))
    assert np.allclose(got, want / mass)


def test_blocks_do_not_change_long_sequences():
    rng = np.random.default_rng(6)
    emission = rng.normal(0, 3, (5000, 4))
    bounds = np.array([0, 17, 4000, 5000])
    args = (rng.normal(0, 2, (4, 4)), rng.normal(0, 1, 4))
    assert np.allclose(li.forward_backward(emission, bounds, *args, 32), li.forward_backward(emission, bounds, *args, 701))


@pytest.fixture(scope="module")
def field(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return li.fit(li.training_windows(docs))


def test_held_out_accuracy_and_contract(spark, sf, docs):
    got = li.op9_language_id(spark, sf).join(docs, "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    own = [r for r in got if r.held_out and r.lang is not None]
    assert np.mean([r.lang == r.lang_pred for r in own]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_are_not_read(docs):
    other = docs.withColumn("lang", F.when(li.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert li.training_windows(other, rows=20) == li.training_windows(docs, rows=20)


def test_switched_text_is_labelled_by_word(field, docs):
    rows = {r.lang: r.text.split()[:60] for r in docs.where("lang in ('de', 'es') and length(text) > 2000").collect()}
    words = rows["de"] + rows["es"]
    data, offsets = li.lower([" ".join(words)])
    w = li.tx.Words(data, offsets)
    got = field.marginals(field.emissions(data, w.start, w.end, w.hashes()), w.bounds).argmax(1)
    names = [field.languages[i] for i in got]
    assert np.mean([n == ("de" if i < 60 else "es") for i, n in enumerate(names)]) > 0.9


def test_odd_rows(spark, odd, no_docs, field):
    from tests.llm.conftest import odd_rows

    rows = {}
    for r in li.identify(odd, field).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == len(odd_rows())
    assert all(rows[i][0].lang_pred == "und" and rows[i][0].score == 0 for i in (0, 1, 2, 7))
    assert all(rows[i][0].lang_pred in field.languages for i in (3, 4, 5, 6, 8))
    assert len({(r.lang_pred, r.score) for r in rows[300]}) == 1
    assert li.identify(no_docs, field).count() == 0
    assert li.fit(li.training_windows(no_docs)) is None
    assert {r.lang_pred for r in li.identify(odd, None).collect()} == {"und"}
    one = li.fit([("xx", ["a", "b"])])
    assert {r.lang_pred for r in li.identify(odd, one).collect()} == {"und", "xx"}
