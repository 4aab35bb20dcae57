"""Long repeated byte strings, found with run-length indexes.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
anywhere else in the corpus. Four steps:

1. Work is dealt out by content. Of the ``GRAM``-byte grams of every
   ``LENGTH``-byte window the one of least hash (the first of equals) is the
   window's anchor; equal windows have equal anchors at equal offsets. Windows
   that follow one another on one anchor are a passage, one narrow row.
   Only passages whose anchor gram occurs twice or more can hold a match.
2. Equal passages are one row with a count; two or more match as a whole.
3. The different passages of one anchor gram are a bucket. Tasks build a
   run-length index (``runlength``) over whole buckets, about ``BLOCK_BYTES``
   at a time, stream its matching statistics and mark the windows whose match
   is ``LENGTH`` bytes or longer. Every window is in one passage only, and
   windows that equal each other are in one bucket.
4. A bucket of more than ``BUCKET`` different passages (a common passage's edge)
   is not indexed in one task: its windows are dealt again by offset and by the
   bytes that all windows of that range of offsets share, and where these still
   hold differing ones, by the window's own hash. All links stay whole, and no
   key gathers rows: these steps are counts with partial sums and joins.

Marks go back to the rows by text hash. Only narrow rows and two joins with the
texts are shuffled.

Defined results: a null text is empty; texts under ``LENGTH`` bytes are kept;
copies of a text (with any doc_id, null too) are other places and lose what the
text repeats, so copies of ``LENGTH`` bytes or more go entirely; matches never
cross texts; an empty table gives an empty result. A very long text is worked
through in pieces that overlap. Only ``doc_id`` and ``text`` are read;
``remove_repeats`` passes all other columns through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import text as tx
from parley.llm.runlength import RunLengthIndex, ranges
from parley.session import cut_lineage

LENGTH = 400
GRAM = 64
BLOCK_BYTES = 1 << 19
BUCKET = 256  # different passages
OFFSETS = 24  # offsets in a range of step 4
PIECE = 1 << 20

_SHIFT = 10  # bits of a passage's size and of its anchor's offset; bounds LENGTH - GRAM
_MASK = (1 << _SHIFT) - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(b), np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))


class Anchors:
    """Passages of byte strings: (row, first window, last window, anchor, anchor's hash)."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        if not 0 < gram <= length or length - gram > _MASK:
            raise ValueError("the gram must be within the length, by less than 1024 bytes")
        self.length, self.gram = length, gram
        self.power, self.inverse = _powers(1)

    def passages(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the strings data[offsets[i]:offsets[i + 1]]."""
        none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
        windows = np.maximum(np.diff(offsets) - self.length + 1, 0)
        if not windows.any():
            return none
        n, width = len(data), self.length - self.gram + 1
        if len(self.power) < n:
            self.power, self.inverse = _powers(n)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(tx._BYTE[data] * self.power[:n], dtype=np.uint64)])
            h = tx.mix((total[self.gram :] - total[: -self.gram]) * self.inverse[: n - self.gram + 1])
        del total
        # hash above place: the least is the leftmost of equals
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        key = np.concatenate([key, np.full(-len(key) % width, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
        before = np.minimum.accumulate(key, axis=1).ravel()
        after = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        last = n - self.length + 1
        anchor = (np.minimum(after[:last], before[width - 1 : width - 1 + last]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        some = np.flatnonzero(windows)
        start = np.repeat(offsets[:-1][some] - np.concatenate([[0], np.cumsum(windows[some])[:-1]]), windows[some]) + np.arange(windows.sum())
        own = anchor[start]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]))
        lo, hi = start[new], start[np.append(new[1:], len(start)) - 1]
        return np.searchsorted(offsets, lo, side="right") - 1, lo, hi, own[new], h[own[new]]


def _long(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def _text_key(text: str | Column) -> list[Column]:
    filled = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(filled).alias("k1"), F.xxhash64(F.lit(1), filled).alias("k2")]


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns``, k1, k2 (hashes of the text) and text of every row."""
    return docs.select(*columns, *_text_key("text"), F.coalesce("text", F.lit("")).alias("text"))


def passages(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the strings data[offsets[i]:offsets[i + 1]]."""
        none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
        windows = np.maximum(np.diff(offsets) - self.length + 1, 0)
        if not windows.any():
            return none
        n, width = len(data), self.length - self.gram + 1
        if len(self.power) < n:
            self.power, self.inverse = _powers(n)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(tx._BYTE[data] * self.power[:n], dtype=np.uint64)])
            h = tx.mix((total[self.gram :] - total[: -self.gram]) * self.inverse[: n - self.gram + 1])
        del total
        # hash above place: the least is the leftmost of equals
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        key = np.concatenate([key, np.full(-len(key) % width, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
        before = np.minimum.accumulate(key, axis=1).ravel()
        after = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        last = n - self.length + 1
        anchor = (np.minimum(after[:last], before[width - 1 : width - 1 + last]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        some = np.flatnonzero(windows)
        start = np.repeat(offsets[:-1][some] - np.concatenate([[0], np.cumsum(windows[some])[:-1]]), windows[some]) + np.arange(windows.sum())
        own = anchor[start]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]))
        lo, hi = start[new], start[np.append(new[1:], len(start)) - 1]
        return np.searchsorted(offsets, lo, side="right") - 1, lo, hi, own[new], h[own[new]]


def _long(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def _text_key(text: str | Column) -> list[Column]:
    filled = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(filled).alias("k1"), F.xxhash64(F.lit(1), filled).alias("k2")]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """k1, k2 (hashes of the text), text and n, the number of rows that hold it."""
    rows = docs.select(*_text_key("text"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))


def passages(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """k1, k2, place (first window, size and anchor's offset packed), gram (the anchor's hash) and content (the passage's hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)

        def rows(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, base: np.ndarray) -> pa.RecordBatch:
            row, lo, hi, at, h = anchors.passages(data, offsets)
            whole = memoryview(np.ascontiguousarray(data))
            content = np.array([xxhash.xxh3_64_intdigest(whole[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist())], np.uint64)
            place = ((lo - offsets[row] + base[row]) << (2 * _SHIFT)) | ((hi - lo) << _SHIFT) | (at - lo)
            of = pa.array(row)
            keys = [batch.column(c).take(of) for c in ("k1", "k2")]
            return pa.RecordBatch.from_arrays([*keys, pa.array(place), pa.array(_long(h)), pa.array(_long(content))], ["k1", "k2", "place", "gram", "content"])

        for batch in batches:
            for a, b in tx.slices(batch.column("text"), piece):
                part = batch.slice(a, b - a)
                data, offsets = tx.raw(part.column("text"))
                if len(data) <= 2 * piece:
                    yield rows(part, data, offsets, np.zeros(len(part), np.int64))
                    continue
                for i in range(len(part)):  # a text beyond the slice's size, piece by piece
                    own = data[offsets[i] : offsets[i + 1]]
                    for x in range(0, max(len(own) - length + 1, 0), piece):
                        cut = own[x : x + piece + length - 1]
                        yield rows(part.slice(i, 1), cut, np.array([0, len(cut)]), np.array([x]))

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, place long, gram long, content long")


_SPANS = "array<struct<a:int,b:int>>"


def _index(length: int, block: int):
    """Marks of the passages of whole buckets (sorted by gram), a block of buckets at a time."""

    def marks(rows: list[tuple]) -> pa.RecordBatch:
        bounds = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])])
        index = RunLengthIndex(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), bounds)
        found = [(r[0], r[1], ranges(s)) for r, s in zip(rows, index.repeated(length)) if len(s) and r[2] == 1]
        spans = pa.array([[{"a": a, "b": b} for a, b in f[2]] for f in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), spans], ["gram", "content", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "content", "n", "bytes"))):
                if row[:2] == last:
                    continue  # cut from another copy of the text
                if rows and row[0] != last[0] and size >= block:
                    yield marks(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[3]), row[:2]
        if rows:
            yield marks(rows)

    return run


def _dealt_again(passages_: DataFrame, length: int, offsets: int) -> DataFrame:
    """gram, content and spans of passages (gram, content, n, anchor, bytes) by offset ranges and, where these hold differing windows, single windows."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, c, n, at, raw in zip(*(batch.column(x).to_pylist() for x in ("gram", "content", "n", "anchor", "bytes"))):
                size = len(raw) - length  # windows 0 to size, window w has offset at - w
                for r in range((at - size) // offsets, at // offsets + 1):
                    a, b = max(0, at - r * offsets - offsets + 1), min(size, at - r * offsets)
                    shared = raw[at - r * offsets : at - r * offsets - offsets + 1 + length]
                    out.append((g, c, n, a, b, xxhash.xxh3_64_intdigest(shared, r) - (1 << 63), xxhash.xxh3_64_intdigest(raw[a : b + length]) - (1 << 63)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], pa.schema([(x, pa.int64()) for x in names]))

    names = ["gram", "content", "n", "a", "b", "shared", "part"]
    parts = cut_lineage(passages_.mapInArrow(first, ", ".join(f"{x} long" for x in names)))
    same = parts.groupBy("shared", "part").agg(F.sum("n").alias("total"))
    kinds = same.groupBy("shared").agg(F.count(F.lit(1)).alias("kinds"))
    sure = parts.join(same.where("total > 1"), ["shared", "part"]).select("gram", "content", "a", "b")
    mixed = parts.join(kinds.where("kinds > 1"), "shared").groupBy("gram", "content").agg(F.collect_list(F.struct("a", "b")).alias("open"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g, c, n, raw, open_ in zip(*(batch.column(x).to_pylist() for x in ("gram", "content", "n", "bytes", "open"))):
                for w in (w for r in open_ for w in range(r["a"], r["b"] + 1)):
                    h = xxhash.xxh3_128_intdigest(raw[w : w + length])
                    out.append((g, c, n, w, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)))
            yield pa.RecordBatch.from_pylist([dict(zip(wide, o)) for o in out], pa.schema([(x, pa.int64()) for x in wide]))

    wide = ["gram", "content", "n", "a", "h1", "h2"]
    windows = cut_lineage(passages_.join(mixed, ["gram", "content"]).select("gram", "content", "n", "bytes", "open").mapInArrow(second, ", ".join(f"{x} long" for x in wide)))
    twice = windows.groupBy("h1", "h2").agg(F.sum("n").alias("total")).where("total > 1")
    single = windows.join(twice, ["h1", "h2"]).select("gram", "content", "a", F.col("a").alias("b"))
    marks = sure.unionByName(single).select("gram", "content", F.struct(F.col("a").cast("int"), F.col("b").cast("int")).alias("x"))
    return marks.groupBy("gram", "content").agg(F.collect_list("x").cast(_SPANS).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, block: int = BLOCK_BYTES, offsets: int = OFFSETS, piece: int = PIECE) -> DataFrame:
    """k1, k2 and marks (first window of a passage and its marked windows) of every text that repeats something.

    ``bucket``, ``block``, ``offsets`` and ``piece`` only deal out the work.
    """
    texts = texts_of(docs)
    found = cut_lineage(passages(texts, length, gram, piece))
    # equal passages as one row; its text is taken from the first place
    each = found.groupBy("gram", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place")).alias("at"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("times")).where("times > 1")
    contents = cut_lineage(each.join(often, "gram").select("gram", "content", "n", "at", "kinds"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.shiftright("at.place", _SHIFT).bitwiseAND(F.lit(_MASK)).cast("int").alias("b")))
    sure = contents.where("n > 1").select("gram", "content", whole.cast(_SPANS).alias("spans"))

    wanted = contents.where("kinds > 1")
    wanted = wanted.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("at.place", "gram", "content", "n", (F.col("kinds") > bucket).alias("hot"))).alias("wanted"))
    kept = ["gram", "content", "n", "hot", "anchor"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for a, b in tx.slices(batch.column("text")):
                out, raw = [], []
                keys = list(zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in ("k1", "k2"))))
                data, ends = tx.raw(batch.column("text").slice(a, b - a))
                own = memoryview(np.ascontiguousarray(data))
                for i, asked in enumerate(batch.column("wanted").slice(a, b - a)):
                    if keys[i] == last:
                        continue  # copies lie beside one another, as a rule
                    last = keys[i]
                    for w in asked.as_py():
                        lo = int(ends[i]) + (w["place"] >> (2 * _SHIFT))
                        out.append((w["gram"], w["content"], w["n"], w["hot"], w["place"] & _MASK))
                        raw.append(bytes(own[lo : lo + ((w["place"] >> _SHIFT) & _MASK) + length]))
                columns = list(zip(*out)) or [()] * 5
                kinds_ = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds_)), pa.array(raw, pa.binary())], [*kept, "bytes"])

    differing = cut_lineage(texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(cut, "gram long, content long, n long, hot boolean, anchor long, bytes binary"))
    cold = differing.where("not hot").select("gram", "content", "n", "bytes")
    indexed = cold.repartition("gram").sortWithinPartitions("gram", "content").mapInArrow(_index(length, block), f"gram long, content long, spans {_SPANS}")
    dealt = _dealt_again(differing.where("hot").dropDuplicates(["gram", "content"]), length, offsets)
    # written, so that a passage in very many places can be split where they meet
    marked = cut_lineage(sure.unionByName(indexed).unionByName(dealt).groupBy("gram", "content").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    marks = found.join(marked, ["gram", "content"]).select("k1", "k2", F.struct(F.shiftright("place", 2 * _SHIFT).alias("at"), "spans").alias("x"))
    # copies of a text mark the same windows
    return marks.groupBy("k1", "k2").agg(F.collect_set("x").alias("marks"))


def removed_runs(marks: list[dict] | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal runs of bytes that marked windows cover, as (start, end)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((m["at"] + s["a"], m["at"] + s["b"] + length) for m in marks or [] for s in m["spans"]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _figures(raw: bytes, runs: list[tuple[int, int]]) -> tuple:
    return len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest()


_FIGURES = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def _remaining(raw: bytes, runs: list[tuple[int, int]]) -> tuple:
    return _kept(raw, runs), [{"start": a, "end": b} for a, b in runs]


_REMAINING = [("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]


def _per_row(docs: DataFrame, own: DataFrame, length: int, result, fields: list[tuple], schema: str, how: dict) -> DataFrame:
    """``result(raw, runs)`` of every text, beside the first column of ``own`` (that column, k1, k2, text)."""
    first = own.schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tx.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                data, ends = tx.raw(part.column("text"))
                whole = data.tobytes()
                rows = [result(whole[x:y], removed_runs(m, length)) for x, y, m in zip(ends[:-1].tolist(), ends[1:].tolist(), part.column("marks").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), fields))], [first.name, *(n for n, _ in fields)])

    out = T.StructType([first, *T.StructType.fromDDL(schema).fields])
    joined = own.join(repeated_spans(docs, length, **how), ["k1", "k2"], "left")
    return joined.select(first.name, "text", "marks").mapInArrow(run, out)


def remove_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """(row, kept, removed): each input row as one struct, its remaining bytes and the removed runs (start, end)."""
    own = docs.select(F.struct(*docs.columns).alias("row"), *_text_key("text"), F.coalesce("text", F.lit("")).alias("text"))
    return _per_row(docs, own, length, _remaining, _REMAINING, "kept binary, removed array<struct<start:long,end:long>>", how)


def repeat_figures(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return _per_row(docs, texts_of(docs, "doc_id"), length, _figures, _FIGURES, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", how)


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: what every document loses to strings of 400 bytes that start twice or more."""
    return repeat_figures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
