"""Vectorised words against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from parley.llm import text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def random_texts(n=200, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ab é\t\n 中😀Z\x0b\x1c ") for _ in range(rnd.randrange(0, 30))) for _ in range(n)]


def test_words_are_the_runs_of_the_contract():
    texts = random_texts()
    data, offsets = tx.raw(pa.array(texts))
    w = tx.Words(data, offsets)
    got = [[] for _ in texts]
    for row, word in zip(w.row.tolist(), w.words()):
        got[row].append(word.decode())
    assert got == [WORD.findall(t) for t in texts]
    assert [b - a for a, b in zip(w.bounds, w.bounds[1:])] == [len(x) for x in got]


def test_hashes_tell_words_apart():
    texts = random_texts(500)
    w = tx.Words(*tx.raw(pa.array(texts)))
    seen = {}
    for word, h in zip(w.words(), w.hashes().tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_grams_stay_within_rows():
    w = tx.Words(*tx.raw(pa.array(["a b c", "", "d e", "a b c d"])))
    at, h = w.grams(w.hashes(), 3)
    assert at.tolist() == [0, 5, 6] and h[0] == h[1] != h[2]


def test_slices_cover_every_row_once():
    texts = pa.array(["a" * n for n in (0, 5, 100, 3, 0, 7, 1)])
    cut = list(tx.slices(texts, 10))
    assert [x for a, b in cut for x in range(a, b)] == list(range(7))
    assert list(tx.slices(pa.array([], pa.string()))) == []
    assert len(tx.raw(pa.array([], pa.string()))[0]) == 0


def test_sliced_arrays_and_nulls():
    column = tx.filled(pa.array(["aa", None, "b c", ""]).slice(1, 3))
    data, offsets = tx.raw(column)
    assert bytes(data) == b"b c" and offsets.tolist() == [0, 0, 3, 3]
    assert tx.per_row(data == 32, offsets).tolist() == [0, 1, 0]
    assert np.array_equal(tx.Words(data, offsets).row, [1, 1])
