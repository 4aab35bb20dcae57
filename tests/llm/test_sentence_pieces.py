"""Ids against the model's own encoder, lossless decoding under dropout, odd rows."""

import random

import numpy as np
import pytest

from parley.llm import sentence_pieces as sp

sentencepiece = pytest.importorskip("sentencepiece")

FIXED = ["", " ", "   ", "Hello  world", " x", "x ", "a\nb\tc", "é\xa0ﬁ", "中文字符没有空格" * 30, "😀😀 ok", "<0x0A> <s> </s> <unk>", "a" * 300, "ab" * 100 + "   " + "the" * 50, "\x00\x7f"]


@pytest.fixture(scope="module")
def pieces():
    return sp.load()


def texts(n=300, seed=1, alphabet="abc  theing é中\n😀."):
    rnd = random.Random(seed)
    return FIXED + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 200))) for _ in range(n)]


def split(ids, bounds):
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_without_dropout_ids_are_the_models(pieces, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    every = texts() + [r.text for r in docs.limit(80).collect()]
    assert split(*sp.encode(every, np.arange(len(every)), pieces, dropout=0.0)) == [model.encode(x) for x in every]


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_decoding_is_lossless(pieces, dropout):
    every = texts(alphabet="abc  the▁é\n😀") + ["▁", "▁x ▁▁ a▁b", " ▁ "]
    got = split(*sp.encode(every, np.arange(len(every)), pieces, dropout=dropout))
    assert [sp.decode(x, pieces) for x in got] == every


def agenda(text, draw, pieces, seed, dropout):
    """One chunk by the plain definition: look at all neighbours again after each merge."""
    sym = [int(pieces.char[ord(c)]) if ord(c) != sp.MARK else -1 for c in text]
    place = list(range(len(sym)))
    while True:
        best = None
        for i in range(len(sym) - 1):
            p = int(pieces.pair(np.array([sym[i]], np.int32), np.array([sym[i + 1]], np.int32))[0])
            if p >= 0 and not sp._skipped(np.array([draw]), np.array([p]), np.array([place[i]]), seed, dropout)[0]:
                best = min(x for x in (best, (int(pieces.rank[p]), i, p)) if x is not None)
        if best is None:
            return [x for x in sym]
        _, i, p = best
        sym[i : i + 2], place[i : i + 2] = [p], [place[i]]


def test_rounds_and_heap_equal_the_plain_agenda(pieces):
    rnd = random.Random(8)
    for n in (1, 2, 5, 17, 40):
        chunk = " " + "".join(rnd.choice("theandingtionsr") for _ in range(n))
        for dropout in (0.0, 0.2, 0.6):
            want = agenda(chunk, 3, pieces, 5, dropout)
            sym = np.array([pieces.char[ord(c)] for c in chunk], np.int32)
            wide = sp._merge(sym[None], np.array([3], np.uint64), pieces, 5, dropout)[0]
            assert [x for x in wide.tolist() if x > -2] == want
            assert [x for x in sp._merge_long(sym, 3, pieces, 5, dropout).tolist() if x > -2] == want


def test_dropout_varies_and_repeats(pieces):
    text = ["the thing and the other thing " * 40]
    a = sp.encode(text, np.array([1]), pieces, dropout=0.3)[0].tolist()
    assert a == sp.encode(text, np.array([1]), pieces, dropout=0.3)[0].tolist()
    assert a != sp.encode(text, np.array([2]), pieces, dropout=0.3)[0].tolist()
    assert a != sp.encode(text, np.array([1]), pieces, dropout=0.3, seed=4)[0].tolist()
    assert len(a) > len(sp.encode(text, np.array([1]), pieces, dropout=0.0)[0])
    # a text's ids do not depend on what stands beside it
    both = split(*sp.encode(["x y z", text[0], ""], np.array([9, 1, 4]), pieces, dropout=0.3))
    assert both[1] == a


def test_dropout_share(pieces):
    skipped = sp._skipped(np.arange(20_000) % 64, np.arange(20_000) % 700, np.arange(20_000) % 11, 1, 0.1)
    assert 0.08 < skipped.mean() < 0.12


def test_query_round_trips(spark, sf, docs, pieces):
    got = {r.doc_id: r for r in sp.op8_sentence_pieces(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_ids == len(r.ids) for r in got.values())
    assert all(sp.decode(got[r.doc_id].ids, pieces) == r.text for r in rows)


def test_odd_rows(spark, odd, no_docs, pieces):
    from collections import Counter

    from tests.llm.conftest import odd_rows

    got = sp.segment(odd, dropout=0.4).collect()
    want = Counter((r[0], r[1]) for r in odd_rows())
    assert Counter((r.doc_id, sp.decode(r.ids, pieces) if r.ids is not None else None) for r in got) == want
    assert all(r.round_trip for r in got)
    assert len({tuple(r.ids) for r in got if r.doc_id == 300}) == 1
    assert sp.segment(no_docs).count() == 0


def test_every_occurrence_has_its_own_draw():
    pieces = sp.load(sp.MODEL)
    ids, bounds = sp.encode(["internationalization"] * 2000, np.arange(2000), pieces, 0.5)
    assert len({tuple(ids[a:b]) for a, b in zip(bounds, bounds[1:])}) > 64


def test_repeats_have_their_own_draws(spark):
    import corpus_pipeline as cp

    text = "internationalization of considerable undertakings " * 40
    rows = cp.encode(spark, spark.createDataFrame([(1, text)] * 3, "doc_id long, text string"), "").collect()
    assert len({tuple(r.ids) for r in rows}) == 3 and all(r.round_trip for r in rows)
