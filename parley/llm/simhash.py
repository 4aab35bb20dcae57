"""SimHash near-duplicate groups.

A fingerprint bit is 1 if over half of the text's shingle hashes have it.
Fingerprints within ``max_bits`` bits are linked: 64 bits are cut into
``blocks`` blocks; two fingerprints within ``max_bits`` agree on some
``blocks - max_bits`` of them (pigeonhole), so every such choice of blocks is a
join key. Rows meet by key and the Hamming distance is verified.

Equal fingerprints are one node, so copies cost one row. A key met by more than
``cell_rows`` fingerprints is dealt into chunks and every pair of chunks is a
cell of its own: no task sees an unbounded group, no pair is left out. A cell
gives a spanning set of its links, not all its pairs.

Defined results: a null or empty text has fingerprint zero and is linked like
any other; a null doc_id keeps its row and its group (``component_id`` is the
smallest id that is not null; null if there is none); repeated rows share a
group; an empty table gives an empty result. Only ``doc_id`` and ``text`` are
read; ``keep_one`` passes all other columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import text as tx
from parley.llm.components import components
from parley.session import cut_lineage

SHINGLE, MAX_BITS, SEED = 4, 4, 42
CELL_ROWS = 2_000

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every n-word shingle of an ASCII-lower-cased text, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(at[: -n].tolist(), (at[n:] - 1).tolist())], np.uint64)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprint of each span of hashes: bits set in over half of them (empty spans: 0)."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # 255 hashes at most fit a byte lane: count pieces of a span, then add them up
    piece = np.concatenate([np.arange(bounds[i], bounds[i + 1], 255) for i in full])
    owner = np.repeat(full, -(-sizes[full] // 255))
    head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, piece)
        for byte in range(8):
            counts = np.add.reduceat(((lanes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64), head)
            out[full] |= (2 * counts > sizes[full]).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints_of(column: pa.Array, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    column = tx.filled(column)
    out = [np.zeros(0, np.uint64)]
    for a, b in tx.slices(column):
        data, offsets = tx.raw(column.slice(a, b - a))
        whole = data.tobytes()
        hashes = [shingle_hashes(whole[x:y], n, seed) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        bounds = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
        out.append(majority(np.concatenate(hashes), bounds))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_key (a hash of the text, to tell repeated ids apart) and fp (the fingerprint's bits as a long)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fingerprints_of(b.column("text"), n, seed).view(np.int64))], schema.fieldNames())

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema)


def block_masks(blocks: int, max_bits: int = MAX_BITS) -> list[int]:
    """The bit masks of every choice of ``blocks - max_bits`` out of ``blocks`` blocks of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]


def blocks_for(distinct: int, max_bits: int = MAX_BITS) -> int:
    """The fewest blocks with keys so long that chance meetings of ``distinct`` random fingerprints stay below one a row.

    Every choice gives the same links; longer keys cost more key rows.
    """
    blocks = max_bits + 2
    while blocks < 2 * max_bits + 2 and distinct >> (64 * (blocks - max_bits) // blocks):
        blocks += 1
    return blocks


def _spanning(own: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join up each component of one cell's fingerprints (a star from a breadth-first search)."""
    left, links = own, []
    while len(left) > 1:
        root, front = left[0], left[:1]
        left = left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 256):
                rest = np.flatnonzero(~near)
                near[rest] = (np.bitwise_count(front[i : i + 256, None] ^ left[None, rest]) <= max_bits).any(0)
            links += [(int(x), int(root)) for x in left[near]]
            front, left = left[near], left[~near]
    return links


def _cells(max_bits: int):
    """Links of sorted cell rows; a cell never spans tasks, but may span batches."""

    def links(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)]))
        size = np.diff(np.append(first, len(fp)))
        two = first[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
        u, v = [fp[near]], [fp[near + 1]]
        more = [x for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist()) for x in _spanning(fp[a : a + n], max_bits)]
        if more:
            u.append(np.array([x[0] for x in more], np.uint64)), v.append(np.array([x[1] for x in more], np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_cell, kept_fp = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            cell = np.concatenate([kept_cell, np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("k", "key", "i", "j")], 1)])
            fp = np.concatenate([kept_fp, b.column("fp").to_numpy().view(np.uint64)])
            # the last cell may go on in the next batch
            other = np.flatnonzero((cell != cell[-1]).any(1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield links(cell[:cut], fp[:cut])
            kept_cell, kept_fp = cell[cut:], fp[cut:]
        if len(kept_fp):
            yield links(kept_cell, kept_fp)

    return run


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` as far as chains of at most ``max_bits`` bits reach."""
    blocks = blocks or blocks_for(fps.count(), max_bits)
    masks = block_masks(blocks, max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))
    keyed = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.k", "x.key")
    met = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / cell_rows).cast("int")
    dealt = keyed.join(met, ["k", "key"]).withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    cells = dealt.select("k", "key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "k", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )
    by = ["k", "key", "i", "j"]
    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(_cells(max_bits), "u long, v long").distinct()


def near_groups(docs: DataFrame, n: int = SHINGLE, max_bits: int = MAX_BITS, seed: int = SEED, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, text_key, fp, component_id and root (the smallest fingerprint of its group, as a long) of every row."""
    own = cut_lineage(fingerprints(docs, n, seed))
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(nodes.select("fp"), max_bits, blocks, cell_rows))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # fingerprints alone in their group are their own root; groups are few beside them
    group = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(group, "root").select("fp", "component_id", "root")
    return own.join(of, "fp").select("doc_id", "text_key", "fp", "component_id", "root")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each group, the one with the smallest doc_id (then the smallest text hash), with all its columns."""
    groups = near_groups(docs, **how)
    first = groups.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("x"))
    kept = first.select("x.doc_id", "x.text_key").distinct()
    # whole input rows travel as one struct, so their names meet none of these
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.struct(*docs.columns).alias("row"))
    a, b = rows.alias("a"), kept.alias("b")
    rows = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "text_key")], "left_semi")
    one = Window.partitionBy("doc_id", "text_key").orderBy(F.xxhash64("row"))  # a row may be there more than once
    return rows.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprint and group of every document."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
