"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its lower-cased words with their counts. For every
term and each of ``SAMPLES`` samples, keyed hashes give r and c (Gamma(2, 1))
and b (uniform); with weight w, t = floor(ln w / r + b) and the term's value is
a = c / exp(r (t - b) + r). The term of least value, with its t, is the sample;
two texts agree on a sample with probability equal to their generalised Jaccard
similarity, sum of minima over sum of maxima of the counts. A fingerprint
is ``SAMPLES`` times four hex digits.

``edited_pairs`` also fingerprints each text with its last third replaced from
the next document in descending doc_id order. Documents are dealt by id ranges
(bounds from id quantiles, one number for each partition), and each range gets
one more row, the first document of the next range, so every task streams
through its own range.

Defined results: a null or empty text, or one without words, has the all-zero
fingerprint, is alike (1) to another such text and unlike (0) any other; null
doc_ids come last in order, equal ids go by a hash of their text; a single
document is its own next; an empty table gives an empty result. Only ``doc_id``
and ``text`` are read. Rows with one doc_id share a range, as do null ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import text as tx

SAMPLES = 64
SLICE_BYTES = 1 << 19
SEED = 29

_LEVELS = 1 << 16


def _gamma_quantiles(levels: int = _LEVELS) -> np.ndarray:
    """Gamma(2, 1) quantiles at the middle of each of ``levels`` equal slices: 1 - (1 + x) exp(-x) = u, by Newton steps."""
    u = (np.arange(levels) + 0.5) / levels
    x = np.where(u < 0.5, np.sqrt(2 * u), 1 - np.log(1 - u))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x.astype(np.float32)


_GAMMA = _gamma_quantiles()
_LOG_GAMMA = np.log(_GAMMA)


def term_values(term: np.ndarray, weight: np.ndarray, samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """(terms x samples) uint64: the value's order in the upper half, the sample's identity in the lower."""
    with np.errstate(over="ignore"):
        salt = tx.mix((np.arange(samples, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        h = tx.mix(term[:, None] ^ salt[None, :])
        r = _GAMMA[h & np.uint64(_LEVELS - 1)]
        log_c = _LOG_GAMMA[(h >> np.uint64(16)) & np.uint64(_LEVELS - 1)]
        b = (h >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        t = np.zeros(h.shape, np.float32)
        many = np.flatnonzero(weight > 1)
        if len(many):
            t[many] = np.floor(np.log(weight[many]).astype(np.float32)[:, None] / r[many] + b[many])
        value = np.exp(np.clip(log_c - r * (t - b) - r, -80, 80))
        name = h * np.uint64(0xD6E8FEB86659FD93) + t.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        name ^= name >> np.uint64(32)
        return (value.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))


def signatures(texts: list[str], samples: int = SAMPLES, seed: int = SEED) -> np.ndarray:
    """(texts x samples) uint16; all zero for a text without words."""
    data, offsets = tx.raw(pa.array(texts, pa.large_string()))
    data = tx.lower_ascii(data)
    w = tx.Words(data, offsets)
    out = np.zeros((len(texts), samples), np.uint16)
    if not len(w):
        return out
    term, of = np.unique(w.hashes(), return_inverse=True)
    pair, count = np.unique(w.row.astype(np.int64) * len(term) + of, return_counts=True)
    row, of = pair // len(term), pair % len(term)
    kind, back = np.unique(of * (count.max() + 1) + count, return_inverse=True)
    value = term_values(term[kind // (count.max() + 1)], kind % (count.max() + 1), samples, seed)
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for a in range(0, len(head), 64):  # texts at a time, so that the gathered rows stay few
        some = head[a : a + 64]
        end = head[a + 64] if a + 64 < len(head) else len(row)
        least = np.minimum.reduceat(value[back[some[0] : end]], some - some[0], axis=0)
        out[row[some]] = (least & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    same = (a == b).mean(1) if a.shape[1] else np.zeros(len(a))
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), same)


def hex_of(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def fingerprints(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint of every text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tx.filled(batch.column("text"))
            for a, b in tx.slices(column, SLICE_BYTES):
                got = hex_of(signatures(column.slice(a, b - a).to_pylist(), samples, seed))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(got)], schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def edit(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as many first characters of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _ranges(docs: DataFrame, parts: int) -> DataFrame:
    """(at, ghost, order, doc_id, text) rows: each document in its range of ids, descending; a range's first document is also the ghost at the end of the range before it (the first range's: of the last)."""
    spark = docs.sparkSession
    keys = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    asked = [i / parts for i in range(1, parts)]
    found = keys.agg(F.percentile_approx("doc_id", F.array(*(F.lit(x) for x in asked)), F.lit(10_000)).alias("x")).first().x if asked else None
    bounds = np.array(sorted(set(found or [])), np.int64)  # one for each partition, whatever the number of documents
    nulls = len(bounds) + 1

    @F.pandas_udf(T.IntegerType())
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(), side="left"), dtype="int32")

    dealt = keys.withColumn("part", F.when(F.col("doc_id").isNull(), nulls).otherwise(range_of(number)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not(number).alias("id"), F.xxhash64("text").alias("key"))
    dealt = dealt.withColumn("order", order)
    firsts = sorted((r.part, r.x.none, r.x.id, r.x.key) for r in dealt.groupBy("part").agg(F.min("order").alias("x")).collect())
    ghosts = [(*x, firsts[i - 1][0]) for i, x in enumerate(firsts)]
    ghosts = F.broadcast(spark.createDataFrame(ghosts, "g_part int, g_none boolean, g_id long, g_key long, to int"))
    on = (dealt.part == ghosts.g_part) & (dealt.order.none == ghosts.g_none) & (dealt.order.id == ghosts.g_id) & (dealt.order.key == ghosts.g_key)
    places = F.array(F.struct(F.col("part").alias("at"), F.lit(0).alias("ghost")), F.struct(F.col("to").alias("at"), F.lit(1).alias("ghost")))
    rows = dealt.join(ghosts, on, "left").select("order", "doc_id", "text", F.explode(F.filter(places, lambda x: x["at"].isNotNull())).alias("x"))
    rows = rows.select("x.at", "x.ghost", "order", "doc_id", "text")
    return rows.repartitionById(nulls + 1, "at").sortWithinPartitions("at", "ghost", "order")


def edited_pairs(docs: DataFrame, samples: int = SAMPLES, seed: int = SEED, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of every document."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def work(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        """All but the last text, each with the one after it."""
        size, first = 0, 0
        for i in range(len(texts) - 1):
            size += len(texts[i])
            if size < SLICE_BYTES and i < len(texts) - 2:
                continue
            some = texts[first : i + 2]
            edited = [edit(a, b) for a, b in zip(some, some[1:])]
            n = len(edited)
            got = signatures(some + edited, samples, seed)
            own, following, changed = got[:n], got[1 : n + 1], got[n + 1 :]
            empty = ~got.any(1)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[first : i + 1], schema_id), pa.array([len(x) for x in some[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(hex_of(own)), pa.array(hex_of(changed)),
                pa.array(likeness(own, changed, empty[:n], empty[n + 1 :])), pa.array(likeness(own, following, empty[:n], empty[1 : n + 1])),
            ], schema.fieldNames())
            size, first = 0, i + 1

    schema_id = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16()}[docs.schema["doc_id"].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, closed = [], [], False
        for batch in batches:
            for a, b in tx.slices(batch.column("text"), 4 * SLICE_BYTES):
                for ghost, doc_id, text in zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in ("ghost", "doc_id", "text"))):
                    if ghost and closed:
                        continue  # copies of the row after the range
                    ids.append(doc_id)
                    texts.append(text)
                    closed = bool(ghost)
                    if ghost:
                        yield from work(ids, texts)
                        ids, texts = [], []
                if len(texts) > 1:
                    yield from work(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]

    return _ranges(docs, parts).select("ghost", "doc_id", "text").mapInArrow(run, schema)


def op4_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprints of every document and its edited text."""
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
