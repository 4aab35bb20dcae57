"""The prefix trie of conversations, by the Euler-tour technique.

Turns are numbered within their conversations and every prefix is named by two
64-bit sums of hashes of (depth, role, text): running sums along the sorted
turns (``scan``), so a conversation of any length spans tasks. Equal names are
one node; its id is (smallest member, depth). Sorting nodes beside their
children gives every node an enter and an exit arc with the arc that follows:
the first child's enter or the own exit, the next sibling's enter or the
parent's exit. The list is ranked in three steps: tasks join up what follows
within a slice of ``SLICE`` sorted arcs, pointer jumping ranks the remaining
pieces (up to ``SLICE`` of them in one task, more by a logarithmic number of
joins), and the pieces' arcs take their places.
Prefix sums of leaves and savings at arc positions give each node's subtree as
the difference between its exit and its enter arc.

Defined results: rows without conv_id belong to no conversation and are left
out; a null role or text is empty; turns go by number, null first, and equal
numbers by a hash of role and text, so repeated rows are turns one after the
other; a conversation without turns after the rebuilding is a member of the
root; an empty table gives an empty result. ``%`` on a negative conv_id keeps
its sign. Only the four columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.mixing import word_count
from parley.llm.scan import scan, sorted_parts
from parley.session import cut_lineage

GROUP, HEADS = 20, 4
SLICE = 1 << 16
IDS = 4_096  # conversation ids hashed at once


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), a and b (hashes of role and text) and words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().cast("long").alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("number"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), word_count("text").alias("words"), F.lit(1).cast("long").alias("one"),
    )
    parts = sorted_parts(rows, ["conv_id", "known", "number", "a", "b"])
    return scan(parts, ["conv_id"], sums={"place": "one"}).select("conv_id", "place", "a", "b", "words")


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turn rows with ``conv_id``, ``source``, ``place``; members: every conv_id): conversations that begin as the first of their group does.

    Conversation c has the first h turns of c - c % group, h = crc32(c) % heads, then its own after its first h.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    members = turns.select("conv_id").distinct()
    begin = turns.where(F.col("place") < heads).withColumnRenamed("conv_id", "first")
    asked = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("first"), h.alias("h")).where("h > 0")
    shared = asked.join(begin, "first").where("place <= h").withColumn("source", F.lit(0).cast("long"))
    own = turns.where(F.col("place") > h).withColumn("source", F.lit(1).cast("long"))
    columns = ["conv_id", "source", "place", "a", "b", "words"]
    return shared.select(columns).unionByName(own.select(columns)), members


def _paths(rows: DataFrame) -> DataFrame:
    """conv_id, depth, words, the names (p, q) of each turn's prefix and (p0, q0) of the one before, and whether it is the last turn."""
    parts = sorted_parts(rows.withColumn("one", F.lit(1).cast("long")), ["conv_id", "source", "place"])
    deep = scan(parts, ["conv_id"], sums={"depth": "one"}, after={"after": "conv_id"})
    deep = deep.withColumn("a", F.xxhash64("depth", "a")).withColumn("b", F.xxhash64("b", "depth"))
    named = scan(deep, ["conv_id"], sums={"p": "a", "q": "b"}, sums_before={"p0": "a", "q0": "b"})
    return named.select("conv_id", "depth", "words", "p", "q", "p0", "q0", F.coalesce(F.col("after") != F.col("conv_id"), F.lit(True)).alias("last"))


def _ends(ends: DataFrame) -> DataFrame:
    """p, q and the hash of the rising ids that end there; ids are joined up in many tasks, ``IDS`` at a time."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q, c = (batch.column(x).to_numpy() for x in ("p", "q", "conv_id"))
            head = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            cut = sorted({*head.tolist(), *range(0, len(p), IDS)}) if len(p) else []
            texts = [",".join(map(str, c[i:j].tolist())) for i, j in zip(cut, [*cut[1:], len(p)])]
            yield pa.RecordBatch.from_arrays([pa.array(p[cut]), pa.array(q[cut]), pa.array(c[cut]), pa.array(texts, pa.string())], ["p", "q", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, out = None, None, []
        for batch in batches:
            for p, q, ids in zip(*(batch.column(x).to_pylist() for x in ("p", "q", "ids"))):
                if (p, q) != at:
                    out += [(*at, sha.hexdigest())] if at else []
                    at, sha = (p, q), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield from rows(out)
            out = []
        yield from rows([(*at, sha.hexdigest())] if at else [])

    def rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out])], ["p", "q", "ends_sha256"])

    by = ["p", "q", "conv_id"]
    runs = ends.select(by).repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(joined, "p long, q long, first long, ids string")
    return runs.repartition("p", "q").sortWithinPartitions("p", "q", "first").mapInArrow(hashed, "p long, q long, ends_sha256 string")


def _arcs(nodes: DataFrame) -> DataFrame:
    """c, x (arc of the node with smallest member c: twice its depth, and one more for the exit), sc, sx (the arc that follows), leaf, saved and parent."""
    places = F.array(
        F.struct(F.col("p").alias("kp"), F.col("q").alias("kq"), F.lit(0).cast("long").alias("child")),
        F.struct(F.col("p0").alias("kp"), F.col("q0").alias("kq"), F.lit(1).cast("long").alias("child")),
    )
    saved = (F.col("n_convs") - 1) * F.col("words")
    beside = nodes.select(F.explode(F.filter(places, lambda k: (k["child"] == 0) | (F.col("depth") > 0))).alias("k"), F.col("conv_id").alias("c"), "depth", saved.alias("saved")).select("k.*", "c", "depth", "saved")
    rows = scan(sorted_parts(beside, ["kp", "kq", "child", "c"]), ["kp", "kq"], firsts={"parent": "c"}, after={"np": "kp", "nq": "kq", "nc": "c"})
    more = F.coalesce((F.col("np") == F.col("kp")) & (F.col("nq") == F.col("kq")), F.lit(False))
    enter = F.col("child") == 0
    arcs = rows.select(
        "c", (2 * F.col("depth") + F.col("child")).alias("x"),
        F.when(more, F.col("nc")).when(enter, F.col("c")).otherwise(F.col("parent")).alias("sc"),
        F.when(enter, F.when(more, 2 * F.col("depth") + 2).otherwise(2 * F.col("depth") + 1)).otherwise(F.when(more, 2 * F.col("depth")).otherwise(2 * F.col("depth") - 1)).alias("sx"),
        (enter & ~more).cast("long").alias("leaf"), F.when(enter, F.col("saved")).otherwise(F.lit(0)).cast("long").alias("saved"), F.when(~enter, F.col("parent")).alias("parent"),
    )
    none = F.lit(None).cast("long")
    way_out = nodes.where("depth = 0").select(F.col("conv_id").alias("c"), F.lit(1).cast("long").alias("x"), none.alias("sc"), none.alias("sx"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"), none.alias("parent"))
    return arcs.unionByName(way_out)


def _pieces(size: int):
    """Joins up what follows within a slice of sorted arcs: adds the piece's first arc (hc, hx), the steps from it and whether the piece ends here."""

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, x = batch.column("c").to_numpy(), batch.column("x").to_numpy()
        n = len(c)
        known = batch.column("sc").is_valid().to_numpy(zero_copy_only=False)
        sc, sx = (batch.column(s).fill_null(0).to_numpy() for s in ("sc", "sx"))
        ids, own = np.unique(c, return_inverse=True)
        of = np.minimum(np.searchsorted(ids, sc), len(ids) - 1)
        width = int(max(x.max(), sx.max())) + 1
        code, want = own * width + x, of * width + sx
        at = np.minimum(np.searchsorted(code, want), n - 1)
        here = known & (ids[of] == sc) & (code[at] == want)
        to, steps = np.where(here, at, np.arange(n)), here.astype(np.int64)
        for _ in range(max(1, n.bit_length())):
            steps, to = steps + steps[to], to[to]
        begin = np.ones(n, bool)
        begin[at[here]] = False
        head = np.zeros(n, np.int64)
        head[to[begin]] = np.flatnonzero(begin)
        head = head[to]
        made = [pa.array(c[head]), pa.array(x[head]), pa.array(steps[head] - steps), pa.array(~here)]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "hc", "hx", "steps", "tail"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                held.append(batch.slice(a, size))
                if sum(b.num_rows for b in held) >= size:
                    yield piece(pa.concat_batches(held))
                    held = []
        if sum(b.num_rows for b in held):
            yield piece(pa.concat_batches(held))

    return run


def _rank_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks a whole list of pieces by pointer jumping within one task."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    batch = pa.concat_batches(held)
    hc, hx, left = (batch.column(c).to_numpy() for c in ("hc", "hx", "left"))
    at = {key: i for i, key in enumerate(zip(hc.tolist(), hx.tolist()))}
    to = np.array([at.get(key, i) for i, key in enumerate(zip(batch.column("sc").to_pylist(), batch.column("sx").to_pylist()))], np.int64)
    last = to == np.arange(len(to))  # the end of the list follows itself, with nothing to add
    own, steps = np.where(last, left, 0).sum(), np.where(last, 0, left)
    for _ in range(len(to).bit_length()):
        steps, to = steps + steps[to], to[to]
    total = steps + own
    yield pa.RecordBatch.from_arrays([pa.array(hc), pa.array(hx), pa.array(total)], ["hc", "hx", "left"])


def _ranked(pieces: DataFrame, size: int) -> DataFrame:
    """hc, hx and left: the arcs from each piece's start to the end of the tour, by pointer jumping.

    At most ``size`` pieces are ranked in one task; more of them by joins, each
    of which doubles the steps.
    """
    jumps = cut_lineage(pieces)
    count = jumps.count()
    if count <= size:
        return jumps.repartition(1).mapInArrow(_rank_all, "hc long, hx long, left long")
    for _ in range((count - 1).bit_length()):
        open_, done = jumps.where("sc is not null"), jumps.where("sc is null")
        to = jumps.select(F.col("hc").alias("sc"), F.col("hx").alias("sx"), F.col("sc").alias("tc"), F.col("sx").alias("tx"), F.col("left").alias("more"))
        on = open_.join(to, ["sc", "sx"]).select("hc", "hx", F.col("tc").alias("sc"), F.col("tx").alias("sx"), (F.col("left") + F.col("more")).alias("left"))
        jumps = cut_lineage(on.unionByName(done))
    return jumps.select("hc", "hx", "left")


def _tour(arcs: DataFrame, size: int) -> DataFrame:
    """c, depth, parent, n_leaves and saved_tokens of every node."""
    parts = sorted_parts(arcs, ["c", "x"])
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    pieces = cut_lineage(parts.mapInArrow(_pieces(size), f"{kept}, hc long, hx long, steps long, tail boolean").drop("_part"))
    ranked = _ranked(pieces.where("tail").select("hc", "hx", "sc", "sx", (F.col("steps") + 1).alias("left")), size)
    placed = pieces.join(ranked, ["hc", "hx"]).select("c", "x", "leaf", "saved", "parent", (F.col("steps") - F.col("left")).alias("position"))
    tour = scan(sorted_parts(placed, ["position"]), [], sums={"leaves": "leaf", "total": "saved"}, sums_before={"leaves0": "leaf", "total0": "saved"})
    way_in, way_out = F.col("x") % 2 == 0, F.col("x") % 2 == 1
    between = lambda now, before: F.max(F.when(way_out, F.col(now))) - F.max(F.when(way_in, F.col(before)))
    return tour.groupBy("c", F.floor(F.col("x") / 2).alias("depth")).agg(F.max("parent").alias("parent"), between("leaves", "leaves0").alias("n_leaves"), between("total", "total0").alias("saved_tokens"))


def trie(rows: DataFrame, members: DataFrame, size: int = SLICE) -> DataFrame:
    """The nodes over turn rows (conv_id, source, place, a, b, words; sorted by source and place) of ``members`` (conv_id, one row each).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256. ``size`` only deals out the work.
    """
    paths = cut_lineage(_paths(rows))
    zero = F.lit(0).cast("long")
    everyone = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("conv_id is not null")
    root = everyone.select(zero.alias("p"), zero.alias("q"), "conv_id", "n_convs", zero.alias("depth"), zero.alias("words"), zero.alias("p0"), zero.alias("q0"))
    named = paths.groupBy("p", "q").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.min(c).alias(c) for c in ("depth", "words", "p0", "q0")))
    nodes = cut_lineage(named.unionByName(root))
    without = members.join(paths.where("depth = 1"), "conv_id", "left_anti")
    ends = paths.where("last").select("p", "q", "conv_id").unionByName(without.select(zero.alias("p"), zero.alias("q"), "conv_id"))
    kids = nodes.where("depth > 0").groupBy(F.col("p0").alias("p"), F.col("q0").alias("q")).agg(F.count(F.lit(1)).alias("n_children"))
    tour = _tour(_arcs(nodes), size).withColumnRenamed("c", "conv_id")
    full = nodes.join(kids, ["p", "q"], "left").join(_ends(ends), ["p", "q"], "left").join(tour, ["conv_id", "depth"])
    return full.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Query: the trie of the rebuilt conversations."""
    turns = cut_lineage(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie(*rebuilt(turns))
