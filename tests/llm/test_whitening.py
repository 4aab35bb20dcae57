import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import bidiagonal, whitening


def matrices():
    rnd = np.random.default_rng(0)
    q, p = (np.linalg.qr(rnd.standard_normal((40, 40)))[0] for _ in range(2))
    yield from (rnd.standard_normal((n, n)) for n in (1, 2, 3, 8, 64))
    yield np.triu(rnd.standard_normal((30, 30))) * np.logspace(0, -12, 30)[:, None]
    yield rnd.standard_normal((30, 3)) @ rnd.standard_normal((3, 30))  # rank 3
    yield np.tile(rnd.standard_normal(12), (12, 1))
    yield q @ np.diag([5.0] * 10 + [1.0] * 30) @ p  # repeated values
    yield q @ np.diag(np.concatenate([5 + 1e-9 * np.arange(10), np.linspace(0, 1, 30)])) @ p
    yield q @ np.diag(np.concatenate([5 + 1e-5 * np.arange(10), np.linspace(0, 1, 30)])) @ p
    yield np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.ones(20), 1)
    yield np.eye(20)
    yield np.zeros((5, 5))


def test_solver_against_a_dense_one():
    for m in matrices():
        k = min(8, len(m))
        s, v = bidiagonal.leading(m, k)
        top = max(np.linalg.svd(m)[1][0], 1e-300)
        assert np.abs(s - np.linalg.svd(m)[1]).max() <= 1e-14 * top
        assert np.abs(v.T @ v - np.eye(k)).max() < 1e-12
        assert np.abs(m.T @ m @ v - v * s[:k] ** 2).max() <= 1e-13 * top**2


def test_small_singular_values_are_right_to_many_digits():
    a, b = np.array([1.0, 1e-5, 1e-10, 1e-3]), np.array([1e-7, 1e-9, 1e-12])
    got = [s for s, _ in bidiagonal.singular_values(a, b)]
    # the product of the singular values is the determinant
    assert math.isclose(np.prod(got), np.prod(a), rel_tol=1e-12)
    assert math.isclose(got[-1], 1e-10, rel_tol=1e-3)


def brute(vectors, k=8):
    """(ids, n, deviations, whitened, explained) by exact integers and a dense eigensolver."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, total = len(x), x.sum(0)
    deviations = [int(d) for d in ((n * x - total) ** 2).sum(1)]
    y = ((n * x - total) / n).astype(float)
    value, vector = np.linalg.eigh(y.T @ y / n)
    value, vector = value[::-1], vector[:, ::-1]
    return n, deviations, y @ vector[:, :k] / np.sqrt(value[:k]), value[:k] / value.sum()


def check(rows, vectors, k):
    n, deviations, white, explained = brute(vectors, k)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1
    assert 0 <= rows[0].identity_error < 1e-6
    for j in range(k):
        own = [r for r in rows if r.component == j + 1]
        assert len(own) == n
        sign = np.sign(sum(r.whitened * white[r.vec_id, j] for r in own))
        for r in own:
            assert int(r.deviation) == deviations[r.vec_id]
            assert abs(r.whitened - sign * white[r.vec_id, j]) < 1e-6
            assert math.isclose(r.explained, explained[j], rel_tol=1e-9)


def table(spark, vectors, parts=5):
    rows = [(i, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)


@pytest.mark.parametrize("n,d,parts", [(200, 12, 5), (200, 12, 40), (3, 12, 2), (50, 3, 1)])
def test_against_brute_force(spark, n, d, parts):
    rnd = np.random.default_rng(n + d)
    vectors = np.float32(rnd.standard_normal((n, d)) * np.linspace(0.2, 1, d)).tolist()
    rows = whitening.whiten(table(spark, vectors, parts)).collect()
    check(rows, vectors, min(8, d, n - 1))


def test_odd_rows(spark):
    rnd = np.random.default_rng(3)
    good = np.float32(rnd.standard_normal((30, 6))).tolist()
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [0.5] * 4]
    df = table(spark, good + bad)
    clash = df.withColumns({c: F.lit("x") for c in ("component", "n", "deviation", "whitened", "part", "r", "width", "dim", "rows", "total")})
    check(whitening.whiten(clash, components=4).collect(), good, 4)
    nameless = df.withColumn("vec_id", F.when(F.col("vec_id") > 3, F.col("vec_id")))
    assert whitening.whiten(nameless, components=4).where("vec_id is null").count() == 16
    again = df.unionAll(df)
    assert {r.n for r in whitening.whiten(again).select("n").distinct().collect()} == {60}


def test_no_variance_and_empty(spark):
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 4)).count() == 0
    assert whitening.whiten(table(spark, [[1.0, 2.0]])).count() == 0
    empty = whitening.whiten(table(spark, []))
    assert empty.count() == 0 and empty.columns[:4] == ["vec_id", "component", "n", "deviation"]
    rows = whitening.whiten(table(spark, [[1.0, 2.0], [1.0, 3.0], [1.0, 7.0]])).collect()
    assert {r.component for r in rows} == {1} and rows[0].explained == pytest.approx(1)


def test_huge_entries(spark):
    rows = whitening.whiten(table(spark, [[3e38, 1.0], [-3e38, 2.0], [5.0, 9.0]])).collect()
    assert len({r.component for r in rows}) >= 1
    x = [2**52, -(2**52), 5 * 1024]
    assert {int(r.deviation) for r in rows if r.vec_id == 0} == {(3 * x[0] - sum(x)) ** 2 + (3 * 1024 - 12 * 1024) ** 2}
    assert all(isinstance(r.deviation, Decimal) for r in rows)


def test_query(spark, sf):
    rows = whitening.op13_embedding_whitening(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    place = {r.vec_id: i for i, r in enumerate(table)}
    n, deviations, white, explained = brute([r.embedding for r in table])
    assert len(rows) == 8 * n
    for j in range(8):
        own = [r for r in rows if r.component == j + 1]
        sign = np.sign(sum(r.whitened * white[place[r.vec_id], j] for r in own))
        assert max(abs(r.whitened - sign * white[place[r.vec_id], j]) for r in own) < 1e-7
        assert all(r.deviation == deviations[place[r.vec_id]] for r in own)
        assert own[0].explained == pytest.approx(explained[j], rel=1e-9)
    assert rows[0].identity_error < 1e-9
