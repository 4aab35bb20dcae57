"""Edited texts against plain Python, likeness against generalised Jaccard."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import weighted_sampling as ws


def jaccard(a, b):
    a, b = (Counter(x.encode().lower().split()) for x in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def plain(rows):
    """(id, text, edited, next) in descending id order, nulls last."""
    texts = [t or "" for _, t in rows]
    after = texts[1:] + texts[:1]
    return [(d, t, t[: len(t) - len(t) // 3] + n[: len(t) // 3], n) for (d, _), t, n in zip(rows, texts, after)]


def test_query_against_plain_python(spark, sf, docs):
    got = {r.doc_id: r for r in ws.op4_weighted_sampling(spark, sf).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    assert len(got) == len(rows)
    error, by_text = [], {}
    for d, text, edited, following in plain(rows):
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        error += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, following)]
    assert abs(np.mean(error)) < 0.01 and np.mean(np.abs(error)) < 0.05


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_ranges_hand_over_their_first_rows(spark, parts):
    rnd = random.Random(parts)
    ids = rnd.sample(range(-500, 10**12), 37)
    rows = sorted(((d, "".join(rnd.choice("ab é") for _ in range(rnd.randrange(0, 40)))) for d in ids), reverse=True)
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in ws.edited_pairs(df, parts=parts).collect()}
    assert len(got) == len(rows)
    for d, _, edited, _ in plain(rows):
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_samples_are_consistent():
    rng = np.random.default_rng(3)
    weight = rng.integers(1, 9, 300)
    terms = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    more = weight + rng.integers(0, 4, 300)
    a = ws.term_values(terms, weight, 2000).min(0) & np.uint64(0xFFFFFFFF)
    b = ws.term_values(terms, more, 2000).min(0) & np.uint64(0xFFFFFFFF)
    want = np.minimum(weight, more).sum() / np.maximum(weight, more).sum()
    assert abs((a == b).mean() - want) < 0.04


def test_gamma_table():
    x = ws._GAMMA.astype(float)
    assert abs(x.mean() - 2) < 0.01 and abs(x.var() - 2) < 0.05 and (np.diff(x) >= 0).all()


def test_odd_rows(spark, odd, no_docs):
    from tests.llm.conftest import odd_rows

    got = ws.edited_pairs(odd, parts=4).collect()
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((d, len(t or "")) for d, t in rows)
    key = {r[0]: r.key for r in odd.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), key[r[1] or ""]))
    assert Counter(r.edited_sha256 for r in got) == Counter(hashlib.sha256(e.encode()).hexdigest() for _, _, e, _ in plain(order))
    zero = "0" * 4 * ws.SAMPLES
    blank = [r for r in got if r.doc_id in (0, 1, 2)]
    assert all(r.fingerprint == zero for r in blank)
    assert ws.edited_pairs(no_docs).count() == 0 and ws.fingerprints(no_docs).count() == 0
    one = ws.edited_pairs(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(ws.edit("a b c d e f", "a b c d e f").encode()).hexdigest()
    assert {r.fingerprint for r in ws.fingerprints(odd).where("doc_id = 300").collect()} == {next(r.fingerprint for r in got if r.doc_id == 300)}
