"""Embedding whitening by a bidiagonal qd solver.

Entries become integers x = floor(1024 c) + 100000, so sums are exact. Every
task folds its centred rows, block by block, into one triangular factor (QR of
the factor so far on top of the next block); factors are folded sixteen at a
time until one is left, R with R'R the scatter of all rows. Householder
reflections bidiagonalise R, dqds finds its singular values and twisted
factorisations the directions (``bidiagonal``); a last pass projects the rows.
What the driver holds is as wide as a vector (sums, R), whatever the rows.

Defined results: a vector that is null, empty, or holds a null or non-finite
entry is dropped, as is one whose length is not the most frequent (of equally
frequent lengths the longest stays); a null vec_id is a row like any other and
repeated rows are all fitted and returned; components of no variance (a
singular value within rounding of zero) are not numbered, so vectors that are all equal
give no rows; an empty table gives an empty result. x saturates at 2 ** 52;
``deviation`` is exact at any size (a decimal; the query's long is null where
it does not fit). Only the id and the vector column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.bidiagonal import leading

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAN_IN = 16
BLOCK_ROWS = 2_048
_LIMIT = 2.0**52
_EXACT = Context(prec=60)


def integers(column: pa.Array, width: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x) of the usable vectors of a list column, one length at a time (only ``width``, if given)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()  # null lists have no entries here
    c = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    finite = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    usable = (lengths > 0) & (finite[ends] == finite[ends - lengths])
    for n in [width] if width else np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == n))
        at = (ends[rows] - n)[:, None] + np.arange(n)[None, :]
        yield n, rows, (np.clip(np.floor(SCALE * c[at]), -_LIMIT, _LIMIT)).astype(np.int64) + SHIFT


def _total(x: np.ndarray) -> list[Decimal]:
    """Exact column sums."""
    if len(x) and np.abs(x).max() * float(len(x)) < 2.0**62:
        return [Decimal(v) for v in x.sum(0).tolist()]
    return [Decimal(sum(col)) for col in x.T.tolist()]


def sums(vectors: DataFrame, column: str = "embedding") -> tuple[int, list[int]]:
    """(n, S): the number of usable vectors of the most frequent length and their sums, exact; (0, []) without any."""
    part = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("total", T.DecimalType(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[Decimal]]] = {}
        for batch in batches:
            for n, rows, x in integers(batch.column(0)):
                old = found.get(n, (0, [Decimal(0)] * n))
                found[n] = (old[0] + len(rows), [_EXACT.add(a, b) for a, b in zip(old[1], _total(x))])
        for n, (rows, total) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([n] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([rows] * n, pa.int64()), pa.array(total, pa.decimal128(38, 0))], part.fieldNames())

    by_dim = vectors.select(column).mapInArrow(run, part).groupBy("width", "dim").agg(F.sum("rows").alias("rows"), F.sum("total").cast("decimal(38,0)").alias("total"))
    one = by_dim.groupBy("width").agg(F.max("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("dim", "total"))).alias("x"))
    top = one.orderBy(F.desc("rows"), F.desc("width")).first()  # one vector's sums
    return (top.rows, [int(v.total) for v in top.x]) if top else (0, [])


class Centre:
    """n and S, and what follows from them for blocks of x."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.total, self.width = n, total, len(total)
        self.whole, self.rest = np.array([t // n for t in total], np.int64), np.array([float(t % n) / n for t in total])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as doubles: the integer part is taken off before rounding."""
        return (x - self.whole).astype(float) - self.rest

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2, exact."""
        rest = np.array([t % self.n for t in self.total], object)
        y = x - self.whole
        if len(x) and (float(np.abs(y).max()) + 1) * self.n < 2.0**31 / max(1.0, self.width**0.5):
            return pa.array(((y * self.n - rest.astype(np.int64)) ** 2).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
        values = [sum((int(v) * self.n - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]
        return pa.array([Decimal(v) if v < 10**38 else None for v in values], pa.decimal128(38, 0))


def _fold(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if r is None else np.concatenate([r, block]), mode="r")


def triangular(vectors: DataFrame, centre: Centre, column: str = "embedding") -> np.ndarray:
    """R (width x width) with R'R the scatter of all usable rows."""
    schema, width = "part int, r binary", centre.width

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for _, _, x in integers(batch.column(0), width):
                for a in range(0, len(x), BLOCK_ROWS):
                    r = _fold(r, centre.centred(x[a : a + BLOCK_ROWS]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()])], ["part", "r"])

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, r = None, None
        for batch in batches:
            for p, raw in zip(batch.column("part").to_pylist(), batch.column("r").to_pylist()):
                if r is not None and p != part:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.tobytes()])], ["part", "r"])
                    r = None
                part, r = p, _fold(r, np.frombuffer(raw).reshape(-1, width))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.tobytes()])], ["part", "r"])

    found = vectors.select(column)
    parts = found.rdd.getNumPartitions()
    found = found.mapInArrow(rows, schema)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        found = found.select(F.floor(F.col("part") / FAN_IN).cast("int").alias("part"), "r").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(factors, schema)
    r = np.frombuffer(found.first().r).reshape(-1, width)
    return np.concatenate([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def identity_error(vectors: DataFrame, centre: Centre, project: np.ndarray, column: str = "embedding") -> float:
    """The largest absolute entry of the projections' covariance minus the identity, measured over all rows."""
    k = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, _, x in integers(batch.column(0), centre.width):
                for a in range(0, len(x), BLOCK_ROWS):
                    w = centre.centred(x[a : a + BLOCK_ROWS]) @ project
                    n, mean, scatter = _merge((n, mean, scatter), (len(w), w.mean(0), (w - w.mean(0)).T @ (w - w.mean(0))))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN_IN], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])], ["part", "n", "mean", "scatter"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        out = (0, np.zeros(k), np.zeros((k, k)))
        for row in table.to_pylist():
            out = _merge(out, (row["n"], np.array(row["mean"]), np.array(row["scatter"]).reshape(k, k)))
        return pa.table({"part": pa.array([key[0].as_py() // FAN_IN], pa.int32()), "n": pa.array([out[0]], pa.int64()), "mean": [out[1].tolist()], "scatter": [out[2].ravel().tolist()]})

    schema = "part int, n long, mean array<double>, scatter array<double>"
    found = vectors.select(column)
    parts = -(-found.rdd.getNumPartitions() // FAN_IN)
    found = found.mapInArrow(run, schema).groupBy("part").applyInArrow(merge, schema)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        found = found.groupBy("part").applyInArrow(merge, schema)
    row = found.first()
    return float(np.abs(np.array(row.scatter).reshape(k, k) / row.n - np.eye(k)).max())


def _merge(a: tuple, b: tuple) -> tuple:
    """Counts, means and centred scatters of two sets put together."""
    if not a[0]:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and identity_error, a row for every usable vector and component."""
    schema = T.StructType([
        T.StructField("vec_id", vectors.schema[vec_id].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    vectors = vectors.select(F.col(vec_id).alias("vec_id"), F.col(column).alias("embedding"))
    n, total = sums(vectors)
    nothing = vectors.sparkSession.createDataFrame([], schema)
    if not n:
        return nothing
    centre = Centre(n, total)
    values, v = leading(triangular(vectors, centre), min(components, centre.width))
    rank = int((values > max(n, centre.width) ** 0.5 * 8 * np.finfo(float).eps * values[0]).sum()) if values[0] > 0 else 0
    k = min(rank, v.shape[1])
    if not k:
        return nothing
    project = v[:, :k] / (values[:k] / n**0.5)
    explained = values[:k] ** 2 / (values**2).sum()
    error = identity_error(vectors, centre, project)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, x in integers(batch.column("embedding"), centre.width):
                for a in range(0, len(x), BLOCK_ROWS):
                    part = x[a : a + BLOCK_ROWS]
                    m = len(part)
                    each = pa.array(np.repeat(np.arange(m), k))
                    yield pa.RecordBatch.from_arrays([
                        batch.column("vec_id").take(pa.array(rows[a : a + m])).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), centre.deviation(part).take(each),
                        pa.array((centre.centred(part) @ project).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ], schema.fieldNames())

    return vectors.mapInArrow(run, schema)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """Query: the whitened first components of every usable embedding."""
    white = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
