"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text gets the model's leading space and is cut before every run of spaces (no
piece of such a model goes on past a later space, which ``load`` checks), so
each cut, a space run and the word after it, is a chunk with an agenda of its
own: of all neighbouring symbols whose joint text is a piece, the one with the
best score (then the leftmost) is merged first. A candidate is skipped if the
keyed hash of (seed, draw, piece, place in the chunk) falls under ``dropout``; a
chunk's draw is a hash of the seed, the document's id and the chunk's number.
Without dropout the ids are the model's own.

The chunks of a slice run side by side in numpy: every round merges the best
candidate of each chunk that has one. Chunks over ``WIDE`` characters go through
a heap instead, so one long run without spaces costs n log n.

A character without a piece, and U+2581 itself (which the model cannot tell from
a space), becomes byte pieces; ``decode`` gives back exactly the text.

Defined results: null text: null ids, n_ids 0; empty text: no ids; a null doc_id
draws like id 0; repeated rows get equal ids; an empty table gives an empty
result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import text as tx

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 23
SLICE_BYTES = 1 << 20
WIDE = 64
NONE = np.int32(2**31 - 1)
MARK = 0x2581

_SLOTS = 1 << 20


@dataclass
class Pieces:
    """Lookup tables of a BPE model. Symbols from ``size`` on are characters that pieces hold but that are no piece."""

    size: int
    text: list[bytes]  # decoded bytes of every id
    bytes_at: int  # the id of byte 0
    char: np.ndarray  # code point -> symbol, -1 if none
    key: np.ndarray  # hash slots of (left, right) pairs
    made: np.ndarray  # the piece that each pair makes
    rank: np.ndarray  # symbol -> place in order of scores, best first

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece made of each pair of symbols, -1 if none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = _slot(key)
        out = np.full(len(key), -1, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        while len(open_):
            at = self.key[slot[open_]]
            hit = at == key[open_]
            out[open_[hit]] = self.made[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
            slot[open_] = (slot[open_] + 1) & (_SLOTS - 1)
        return out


def _slot(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (tx.mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)


def load(path: str = MODEL) -> Pieces:
    """Read the pieces and scores of a SentencePiece BPE model with byte fallback (on the driver; tens of thousands of pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    bytes_at = next(i for i in range(size) if model.is_byte(i))
    if [names[bytes_at + i] for i in range(256)] != [f"<0x{i:02X}>" for i in range(256)]:
        raise ValueError("the model has no byte pieces")
    mark = chr(MARK)
    if any(mark in names[i].lstrip(mark) for i in plain):
        raise ValueError("a piece goes on past a space")
    known = {names[i]: i for i in plain}
    for c in sorted({c for x in known for c in x} - set(known)):
        known[c] = len(known) + size
    symbols = max(known.values()) + 1
    char = np.full(0x110000, -1, np.int32)
    for x, i in known.items():
        if len(x) == 1 and x != mark:
            char[ord(x)] = i
    char[0x20] = known[mark]
    order = sorted(plain, key=lambda i: (-model.get_score(i), i))
    rank = np.full(symbols, NONE, np.int32)
    rank[order] = np.arange(len(order))
    key, made = np.full(_SLOTS, -1, np.int64), np.full(_SLOTS, -1, np.int32)
    for x in plain:
        name = names[x]
        for i in range(1, len(name)):
            a, b = known.get(name[:i]), known.get(name[i:])
            if a is not None and b is not None:
                k = a << 32 | b
                slot = int(_slot(np.array([k]))[0])
                while key[slot] != -1:
                    slot = (slot + 1) & (_SLOTS - 1)
                key[slot], made[slot] = k, x
    text = [b""] * size
    for i in plain:
        text[i] = names[i].replace(mark, " ").encode()
    for i in range(256):
        text[bytes_at + i] = bytes([i])
    return Pieces(size, text, bytes_at, char, key, made, rank)


def _skipped(draw: np.ndarray, piece: np.ndarray, place: np.ndarray, seed: int, dropout: float) -> np.ndarray:
    """Which candidates (piece made at a place of a chunk) this draw skips."""
    if dropout <= 0:
        return np.zeros(len(draw), bool)
    with np.errstate(over="ignore"):
        h = tx.mix(draw.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        h = tx.mix(h ^ (piece.astype(np.uint64) << np.uint64(32)) ^ place.astype(np.uint64))
    return h < np.uint64(min(int(dropout * 2.0**64), 2**64 - 1))


def _merge(symbol: np.ndarray, draw: np.ndarray, pieces: Pieces, seed: int, dropout: float) -> np.ndarray:
    """Merge every row's agenda to its end. ``symbol``: chunks x width, -2 past the end; merged-away places become -3."""
    n, width = symbol.shape
    symbol = symbol.copy()
    after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int16), (n, width)).copy()
    before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int16), (n, width)).copy()
    made = np.full((n, width), -1, np.int32)
    rank = np.full((n, width), NONE, np.int32)

    def look(rows: np.ndarray, at: np.ndarray) -> None:
        """Set the candidate of the symbol at ``at`` with the next one."""
        right = after[rows, at]
        ok = right < width
        left_symbol, right_symbol = symbol[rows, at], np.where(ok, symbol[rows, np.minimum(right, width - 1)], -1)
        piece = pieces.pair(left_symbol, right_symbol)
        some = np.flatnonzero(piece >= 0)
        drop = _skipped(draw[rows[some]], piece[some], at[some], seed, dropout)
        piece[some[drop]] = -1
        made[rows, at] = piece
        rank[rows, at] = np.where(piece >= 0, pieces.rank[np.maximum(piece, 0)], NONE)

    rows, at = np.nonzero(symbol[:, :-1] >= 0)
    if len(rows):
        look(rows, at)
    live = np.arange(n)
    while len(live):
        best = rank[live].argmin(1)
        go = rank[live, best] < NONE
        live, at = live[go], best[go]
        if not len(live):
            break
        right = after[live, at].astype(np.int64)
        symbol[live, at] = made[live, at]
        symbol[live, right] = -3
        rank[live, right] = NONE
        following = after[live, right]
        after[live, at] = following
        inner = np.flatnonzero(following < width)
        before[live[inner], following[inner]] = at[inner]
        look(live, at)
        previous = before[live, at].astype(np.int64)
        has = np.flatnonzero(previous >= 0)
        look(live[has], previous[has])
    return symbol


def _merge_long(symbol: np.ndarray, draw: int, pieces: Pieces, seed: int, dropout: float) -> np.ndarray:
    """The agenda of one long chunk, by a heap."""
    n = len(symbol)
    sym, after, before = symbol.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def look(at: np.ndarray) -> None:
        right = [after[i] for i in at.tolist()]
        left = np.array([sym[i] for i in at.tolist()], np.int32)
        piece = pieces.pair(left, np.array([sym[j] if j < n else -1 for j in right], np.int32))
        some = np.flatnonzero(piece >= 0)
        some = some[~_skipped(np.full(len(some), draw), piece[some], at[some], seed, dropout)]
        for i in some.tolist():
            p = int(piece[i])
            heapq.heappush(heap, (int(pieces.rank[p]), int(at[i]), p, sym[int(at[i])]))

    look(np.arange(n - 1))
    lengths = [1] * n
    while heap:
        _, i, piece, left = heapq.heappop(heap)
        j = after[i] if sym[i] != -3 else n
        if j >= n or sym[i] != left or sym[i] == -3 or int(pieces.pair(np.array([left]), np.array([sym[j]]))[0]) != piece:
            continue
        sym[i], sym[j] = piece, -3
        lengths[i] += lengths[j]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        look(np.array([k for k in (before[i], i) if k >= 0]))
    return np.array(sym, np.int32)


def encode(texts: list[str], ids: np.ndarray, pieces: Pieces, dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of a slice of texts; ``ids`` are the documents' numbers that key the draws."""
    points = [np.frombuffer(f" {x}".encode("utf-32-le"), np.uint32) if x else np.zeros(0, np.uint32) for x in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in points])]).astype(np.int64)
    cp = np.concatenate(points) if points else np.zeros(0, np.uint32)
    if not len(cp):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space = cp == 0x20
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[bounds[:-1][bounds[:-1] < len(cp)]] = True
    start = np.flatnonzero(head)
    size = np.diff(np.append(start, len(cp)))
    row = np.searchsorted(bounds, start, side="right") - 1
    chunk_bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        # chunks that can have no merge, and all without dropout, are merged once: 64-bit hashes of their code points tell them apart
        power = np.cumprod(np.full(int(size.max()) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
        place = np.arange(len(cp)) - np.repeat(start, size)
        h = tx.mix(np.add.reduceat(tx.mix(cp.astype(np.uint64) + np.uint64(1)) * power[place], start) + size.astype(np.uint64))
        number = (np.arange(len(start)) - chunk_bounds[row]).astype(np.uint64)
        draw = tx.mix(tx.mix(ids.astype(np.uint64)[row] + np.uint64(seed)) ^ number)
        key = np.where(size > 1, tx.mix(h + draw * np.uint64(0xD6E8FEB86659FD93)), h) if dropout > 0 else h
    _, one, back = np.unique(key, return_index=True, return_inverse=True)
    symbol = pieces.char[cp]
    symbol[cp == MARK] = -1
    out_at, out_symbol, out_point = [], [], []
    low = 1
    for high in (4, 8, 12, 16, 24, 32, WIDE):
        some = np.flatnonzero((size[one] >= low) & (size[one] <= high))
        low = high + 1
        for a in range(0, len(some), 65_536):
            part = some[a : a + 65_536]
            at = start[one[part]][:, None] + np.arange(high)
            inside = np.arange(high) < size[one[part]][:, None]
            at = np.where(inside, at, 0)
            got = _merge(np.where(inside, symbol[at], -2), draw[one[part]], pieces, seed, dropout)
            r, c = np.nonzero(got > -2)
            out_at.append(part[r]), out_symbol.append(got[r, c]), out_point.append(cp[at[r, c]])
    for x in np.flatnonzero(size[one] > WIDE).tolist():
        a = start[one[x]]
        got = _merge_long(symbol[a : a + size[one[x]]], int(draw[one[x]]), pieces, seed, dropout)
        c = np.flatnonzero(got > -2)
        out_at.append(np.full(len(c), x)), out_symbol.append(got[c]), out_point.append(cp[a + c])
    at, sym, point = (np.concatenate(x) for x in (out_at, out_symbol, out_point))
    order = np.argsort(at, kind="stable")
    at, sym, point = at[order], sym[order], point[order]
    # symbols that are no piece are spelt in bytes
    spelt = np.flatnonzero((sym < 0) | (sym >= pieces.size))
    times = np.ones(len(sym), np.int64)
    if len(spelt):
        p = point[spelt]
        times[spelt] = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)
        flat = np.repeat(sym, times)
        begin = (np.cumsum(times) - times)[spelt]
        spell = np.frombuffer("".join(map(chr, p.tolist())).encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32) + pieces.bytes_at
        own = times[spelt]
        flat[np.repeat(begin, own) + np.arange(len(spell)) - np.repeat(np.cumsum(own) - own, own)] = spell
        at, sym = np.repeat(at, times), flat
    span = np.searchsorted(at, np.arange(len(one) + 1))
    count = np.diff(span)[back]
    ends = np.cumsum(count)
    flat = np.repeat(span[:-1][back], count) + np.arange(ends[-1]) - np.repeat(ends - count, count)
    return sym[flat].astype(np.int32), np.concatenate([[0], ends])[chunk_bounds]


def decode(ids: list[int], pieces: Pieces) -> str:
    """The text of a sequence of ids."""
    table = pieces.text
    whole = b"".join([table[i] for i in ids])
    return whole[1:].decode() if whole else ""


def segment(docs: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, repeat: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids and round_trip (the ids decode to the text) of every document; ``repeat`` names a column that numbers a document's repeats from 1, which then have draws of their own."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_ids", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(load(path))  # the model's tables, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        for batch in batches:
            column = batch.column("text")
            for a, b in tx.slices(column, SLICE_BYTES):
                texts = column.slice(a, b - a).to_pylist()
                keys = batch.column("draw_key").slice(a, b - a).to_numpy()
                ids, bounds = encode([x or "" for x in texts], keys, pieces, dropout, seed)
                flat, at = ids.tolist(), bounds.tolist()
                null = np.array([x is None for x in texts], bool)
                trip = [x is None or decode(flat[i:j], pieces) == x for x, i, j in zip(texts, at, at[1:])]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(bounds).astype(np.int32)), lists, pa.array(trip)], schema.fieldNames())

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    if repeat:
        key = F.when(F.col(repeat) > 1, F.xxhash64(key, F.col(repeat).cast("long"))).otherwise(key)
    return docs.select("doc_id", key.alias("draw_key"), "text").mapInArrow(run, schema)


def op8_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    """Query: the ids of every document under merge-dropout, decoded again for the check."""
    return segment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
