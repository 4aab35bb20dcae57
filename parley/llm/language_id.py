"""Language identification by a linear-chain conditional random field.

Every word gets a state, one for each learned language. A word's emission is
the sum of learned weights of its affixes, its character n-grams and its place
in the languages' lexicons; transitions are learned too, so a switch within a
text costs what switches cost in training (training sequences are seeded
windows of labelled texts, some of them spliced from two languages).
Forward-backward gives every word's marginals; a document's language is the one
with the largest sum of marginals, its score that sum's share.

Whole sequences are scored: blocks of ``BLOCK`` words are first multiplied into
transfer matrices, the matrices are chained for each text, then every block runs
forward and backward from its exact borders.

Defined results: ``und`` with score 0 where the text is null or has no letter;
a null doc_id is scored and is not held out; repeated rows get equal results; an
empty table gives an empty result; with one learned language everything with a
letter has that language, with none everything is ``und``. Only ``doc_id``,
``text`` and (for training) ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import text as tx
from parley.llm.sample import fold, hash_place, share_for

BITS = 16
BUCKETS = 1 << BITS
BLOCK = 32
FOLDS, HELD_OUT = 3, 1
ROWS_PER_LANGUAGE = 500
WINDOW_WORDS = 40
LEXICON_WORDS = 4_000  # for each language
SPLICED = 0.3

_LETTER = regex.compile(r"\p{L}")


def lower(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return tx.raw(pa.array([x.lower() for x in texts], pa.large_string()))


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket ids, bounds): the distinct-in-kind features of each word: the word, prefixes and suffixes of 1-4 bytes, byte 2- and 3-grams with borders."""
    n = len(start)
    length = end - start
    total = int(length.sum())
    owner = np.repeat(np.arange(n), length)
    at = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    here = data[np.repeat(start, length) + at].astype(np.uint32)
    left, size = length[owner] - at, length[owner]
    pick = lambda shift: np.where(left > shift, data[np.minimum(np.repeat(start, length) + at + shift, len(data) - 1)], 32).astype(np.uint32)
    one, two = pick(1), pick(2)
    back = np.where(at > 0, np.concatenate([[0], here[:-1]]) if total else here, 32).astype(np.uint32)
    with np.errstate(over="ignore"):
        key = lambda kind, v: ((v * np.uint32(2654435761)) ^ np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
        parts = [(owner, key(1, back << np.uint32(16) | here << np.uint32(8) | one)), (owner, key(2, here << np.uint32(8) | one))]
        # prefixes and suffixes: running hashes from either end
        head, tail = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        for k in range(4):
            some = np.flatnonzero(length > k)
            head[some] = (head[some] + data[start[some] + k] + np.uint32(1)) * np.uint32(0x01000193)
            tail[some] = (tail[some] + data[end[some] - 1 - k] + np.uint32(1)) * np.uint32(0x01000193)
            parts += [(some, key(3 + k, head[some])), (some, key(7 + k, tail[some]))]
    del size, two
    order = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
    ids = np.concatenate([p[1] for p in parts])[order].astype(np.int32)
    return ids, np.searchsorted(np.concatenate([p[0] for p in parts])[order], np.arange(n + 1))


@dataclass
class Field:
    languages: list[str]
    weight: np.ndarray  # BUCKETS x languages
    lexicon: np.ndarray  # sorted word hashes
    lexicon_weight: np.ndarray  # a row for each of them
    transition: np.ndarray
    initial: np.ndarray

    def emissions(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        ids, bounds = word_features(data, start, end)
        out = np.add.reduceat(self.weight[ids], bounds[:-1], axis=0) / np.diff(bounds)[:, None] if len(start) else np.zeros((0, len(self.languages)))
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            out = out + np.where((self.lexicon[at] == h)[:, None], self.lexicon_weight[at], 0)
        return out

    def marginals(self, emission: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each word's probabilities of the languages, by forward-backward over each sequence ``bounds[i]:bounds[i + 1]``."""
        return forward_backward(emission, bounds, self.transition, self.initial)


def _norm(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-300)


def forward_backward(emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray, initial: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Marginals of every position, the blocks of all sequences side by side."""
    n, width = emission.shape
    if not n:
        return np.zeros((0, width))
    size = np.diff(bounds)
    live = np.flatnonzero(size)
    blocks_of = -(-size[live] // block)
    first_block = np.concatenate([[0], np.cumsum(blocks_of)])
    total = int(first_block[-1])
    owner = np.repeat(np.arange(len(live)), blocks_of)
    begin = bounds[live][owner] + (np.arange(total) - first_block[owner]) * block
    length = np.minimum(block, bounds[live + 1][owner] - begin)
    at = np.minimum(begin[:, None] + np.arange(block), n - 1)
    inside = np.arange(block) < length[:, None]
    likely = np.exp(emission - emission.max(1, keepdims=True))[at]  # blocks x block x languages
    step = np.exp(transition - transition.max())
    opening = np.arange(total) == first_block[owner]

    def through(state: np.ndarray, k: int) -> np.ndarray:
        """Rows (..., languages) moved over the step into position k of their blocks; a sequence's first word has no step."""
        moved = state @ step
        if k == 0:
            moved = np.where(opening.reshape(-1, *[1] * (state.ndim - 1)), state, moved)
        return moved

    move = np.broadcast_to(np.eye(width), (total, width, width)).copy()
    for k in range(block):
        new = through(move, k) * likely[:, None, k]
        new /= np.maximum(new.sum((1, 2), keepdims=True), 1e-300)
        move = np.where(inside[:, k, None, None], new, move)
    before, after = np.zeros((total, width)), np.ones((total, width))
    start = _norm(np.exp(initial - initial.max()))
    for k in range(int(blocks_of.max())):
        own = first_block[:-1][blocks_of > k] + k
        before[own] = start if k == 0 else _norm((before[own - 1, None] @ move[own - 1])[:, 0])
        last = (first_block[1:] - 1)[blocks_of > k] - k
        if k:
            after[last] = _norm((move[last + 1] @ after[last + 1, :, None])[..., 0])
    forward = np.empty((total, block, width))
    state = before
    for k in range(block):
        new = _norm(through(state, k) * likely[:, k])
        state = np.where(inside[:, k, None], new, state)
        forward[:, k] = state
    out = np.empty((n, width))
    state = after
    for k in range(block - 1, -1, -1):
        here = np.flatnonzero(inside[:, k])
        out[begin[here] + k] = _norm(forward[here, k] * state[here])
        back = (likely[:, k] * state) @ step.T
        if k == 0:
            break
        state = np.where(inside[:, k, None], _norm(back), state)
    return out


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def training_windows(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, words: int = WINDOW_WORDS, seed: int = 5) -> list[tuple[str, list[str]]]:
    """(lang, words) of at most ``rows`` texts a language outside the held-out fold: a seeded window of each text."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # a row for each language; the hash bound leaves few rows to rank, whatever a language's share of the corpus
    there = known.groupBy("lang").agg(F.count(F.lit(1)).alias("there"))
    near = known.select("doc_id", "lang").join(F.broadcast(there), "lang").where(hash_place(seed) < share_for(rows, F.col("there")))
    order = Window.partitionBy("lang").orderBy(hash_place(seed), "doc_id")
    chosen = near.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).select("doc_id", F.col("lang").alias("label")).distinct()
    # at most ``rows`` ids a language
    texts = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").where("lang = label").select("label", "text")
    schema = T.StructType([T.StructField("label", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                every = text.lower().split()
                at = int(np.random.default_rng([seed, len(text)]).integers(0, max(1, len(every) - words + 1)))
                out.append(every[at : at + words])
            yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.string()), pa.array(out, pa.list_(pa.string()))], schema.fieldNames())

    got = texts.mapInArrow(run, schema).toArrow()
    return sorted((x, y) for x, y in zip(got.column("label").to_pylist(), got.column("words").to_pylist()) if y)


def fit(windows: list[tuple[str, list[str]]], rounds: int = 60, rate: float = 0.6, l2: float = 1e-4, spliced: float = SPLICED, lexicon_words: int = LEXICON_WORDS, seed: int = 5) -> Field | None:
    """Log-likelihood ascent (adaptive steps) on windows and on splices of windows from different languages."""
    languages = sorted({x for x, _ in windows})
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    sequences = [(w, [number[x]] * len(w)) for x, w in windows]
    for _ in range(int(spliced * len(windows)) if len(languages) > 1 else 0):
        (a, x), (b, y) = (windows[i] for i in rng.integers(0, len(windows), 2))
        i, j = rng.integers(1, len(x) + 1), rng.integers(1, len(y) + 1)
        sequences.append((x[:i] + y[:j], [number[a]] * i + [number[b]] * j))
    width = len(languages)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x, _ in sequences])])
    truth = np.array([t for _, y in sequences for t in y])
    data, offsets = lower([w for x, _ in sequences for w in x])
    w_start, w_end = offsets[:-1], offsets[1:]
    words = tx.Words(data, offsets)
    h = np.zeros(len(truth), np.uint64)
    h[words.row] = words.hashes()  # windows are split at white space, so each is one word
    counts = {}
    for x, t in zip(h.tolist(), truth.tolist()):
        counts.setdefault(x, np.zeros(width))[t] += 1
    often = [sorted((k for k in counts if counts[k][t] >= 3), key=lambda k: (-counts[k][t], k))[:lexicon_words] for t in range(width)]
    lexicon = np.array(sorted({k for x in often for k in x}), np.uint64)
    field = Field(languages, np.zeros((BUCKETS, width)), lexicon, np.zeros((len(lexicon), width)), np.zeros((width, width)), np.zeros(width))
    if width == 1:
        return field
    ids, spans = word_features(data, w_start, w_end)
    per = np.diff(spans)
    place = np.minimum(np.searchsorted(lexicon, h), max(len(lexicon) - 1, 0)) if len(lexicon) else np.zeros(len(h), int)
    listed = (lexicon[place] == h) if len(lexicon) else np.zeros(len(h), bool)
    first = bounds[:-1]
    inner = np.setdiff1d(np.arange(len(truth)), first)
    want = np.eye(width)[truth]
    seen = [np.full(p.shape, 1e-8) for p in (field.weight, field.lexicon_weight, field.transition, field.initial)]
    for _ in range(rounds):
        emission = field.emissions(data, w_start, w_end, h)
        marginal = field.marginals(emission, bounds)
        gap = (want - marginal) / len(truth)
        g_weight = np.zeros_like(field.weight)
        share = gap / per[:, None]
        for t in range(width):
            g_weight[:, t] = np.bincount(ids, np.repeat(share[:, t], per), BUCKETS)
        g_lexicon = np.zeros_like(field.lexicon_weight)
        np.add.at(g_lexicon, place[listed], gap[listed])
        pair = pair_marginals(emission, bounds, field.transition, field.initial, inner)
        g_move = (want[inner - 1].T @ want[inner] - pair) / len(truth)
        for p, g, s in zip((field.weight, field.lexicon_weight, field.transition, field.initial), (g_weight, g_lexicon, g_move, gap[first].sum(0)), seen):
            g -= l2 * p / len(truth)
            s += g * g
            p += rate * g / np.sqrt(s)
    field.weight = field.weight.astype(np.float32)
    return field


def pair_marginals(emission, bounds, transition, initial, inner) -> np.ndarray:
    """Expected counts of each pair of neighbouring states (training windows are short: plain forward and backward steps)."""
    size = np.diff(bounds)
    width, longest = emission.shape[1], int(size.max())
    at = np.minimum(bounds[:-1, None] + np.arange(longest), len(emission) - 1)
    inside = np.arange(longest) < size[:, None]
    likely = np.exp(emission - emission.max(1, keepdims=True))[at]
    step = np.exp(transition - transition.max())
    forward = np.zeros((len(size), longest, width))
    state = _norm(np.exp(initial - initial.max()) * likely[:, 0])
    forward[:, 0] = state
    for k in range(1, longest):
        state = np.where(inside[:, k, None], _norm((state @ step) * likely[:, k]), state)
        forward[:, k] = state
    total, state = np.zeros((width, width)), np.ones((len(size), width))
    for k in range(longest - 1, 0, -1):
        own = inside[:, k]
        pair = forward[own, k - 1][:, :, None] * step[None] * (likely[own, k] * state[own])[:, None, :]
        total += (pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)).sum(0)
        state[own] = _norm((likely[own, k] * state[own]) @ step.T)
    return total


def document_languages(texts: list[str], field: Field | None) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    lettered = [i for i, x in enumerate(texts) if _LETTER.search(x)]
    if field is None or not lettered:
        return names, scores
    data, offsets = lower([texts[i] for i in lettered])
    w = tx.Words(data, offsets)
    h = w.hashes()
    unique, one, back = np.unique(h, return_index=True, return_inverse=True)
    emission = field.emissions(data, w.start[one], w.end[one], unique)[back]
    marginal = field.marginals(emission, w.bounds)
    weight = np.add.reduceat(marginal, w.bounds[:-1], axis=0) / np.diff(w.bounds)[:, None]
    for i, share in zip(lettered, weight):
        names[i], scores[i] = field.languages[int(share.argmax())], share.max()
    return names, scores


def identify(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS and lexicon rows, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tx.filled(batch.column("text"))
            for a, b in tx.slices(column):
                names, scores = document_languages(column.slice(a, b - a).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1))], schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("score", F.round("score", 6))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Query: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = fit(training_windows(docs))
    return identify(docs, field).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
