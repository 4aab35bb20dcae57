"""Bounded, seeded samples of labelled rows for fitting (the bound is a parameter)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: null)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(folds))


_RANGE = 1 << 32


def hash_place(seed: int) -> Column:
    """A keyed hash of the id as a number below 2 ** 32."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_RANGE))


def share_for(rows: int, there: Column) -> Column:
    """Hash places below this hold about four times ``rows`` of ``there`` rows, so that few meet where the first ``rows`` are taken."""
    return F.least(F.lit(float(_RANGE)), F.lit(4.0 * rows * _RANGE) / F.greatest(there, F.lit(1)))


def labelled_sample(labels: DataFrame, label: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` (doc_id, label) rows, those with the smallest keyed hashes.

    Null ids and null labels are left out; an id labelled more than once takes
    the rounded mean of its labels.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    near = known.where(hash_place(seed) < share_for(rows, F.lit(known.count())))
    one = near.groupBy("doc_id").agg(F.round(F.avg(F.col(label).cast("double"))).cast("int").alias("label"))
    return one.orderBy(hash_place(seed), "doc_id").limit(rows)


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, label, text) of the sampled ids; the sample is broadcast, its row bound is ``labelled_sample``'s."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
