"""Counts against plain Python, the trees' order and accuracy, odd rows."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import quality_rules as qr
from parley.llm import trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def check(rows, texts):
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept) and 0 <= r.score <= 1


def test_query_against_plain_python(spark, sf, docs):
    rows = qr.op10_quality_rules(spark, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    check(rows, texts)


def test_verdict_follows_labels(spark, sf, labels):
    got = qr.op10_quality_rules(spark, sf).where("not base_failed").join(labels, "doc_id")
    right = got.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95
    assert got.where("quality = 1").select(F.avg(F.col("kept").cast("double"))).first()[0] > 0.98


def test_odd_rows(spark, odd, labels, no_labels, no_docs):
    from tests.llm.conftest import odd_rows

    rows = qr.apply_rules(odd, qr.fit_rules(odd, no_labels)).collect()
    assert sorted((r.n_words, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted((p[0], p[3], p[4]) for p in (plain(x[1]) for x in odd_rows()))
    assert all(r.score == 1 and r.kept != r.base_failed for r in rows)
    assert qr.apply_rules(no_docs, None).count() == 0 and qr.document_stats(no_docs).count() == 0
    nulls = spark.createDataFrame([(None, 1, 0), (100, None, 0), (101, 1, 1), (101, 1, 1), (102, 0, 0)], "doc_id long, quality int, toxic int")
    assert qr.apply_rules(odd, qr.fit_rules(odd, nulls)).count() == len(odd_rows())


def test_trees_keep_the_asked_order():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] + np.sin(9 * x[:, 1]) + rng.normal(0, 0.4, 3000)) > 0.8).astype(float)
    forest = trees.fit(x, y, np.array([1, -1, 0, 1]), trees=40)
    for j, sign in ((0, 1), (1, -1), (3, 1)):
        base = rng.random((200, 4))
        last = None
        for v in np.linspace(-0.1, 1.1, 25):
            base[:, j] = v
            now = sign * forest.margin(base)
            assert last is None or (now >= last - 1e-9).all()
            last = now


def test_flat_scoring_equals_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((500, 3))
    forest = trees.fit(x, (x[:, 0] > 0.5).astype(float), np.zeros(3, int), trees=10)
    for row, got in zip(x[:50], forest.margin(x[:50])):
        total = forest.base
        for f, c, v in zip(forest.feature, forest.cut, forest.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += v[node - len(f)]
        assert got == pytest.approx(total)
