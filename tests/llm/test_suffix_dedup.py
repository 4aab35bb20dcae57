import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import suffix_dedup as sd
from parley.llm.runlength import RunLengthIndex, ranges

RUNS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def longest_elsewhere(strings):
    places = [(i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)]

    def common(s, t):
        k = 0
        while k < min(len(s), len(t)) and s[k] == t[k]:
            k += 1
        return k

    return [max([common(strings[i][j:], strings[a][b:]) for a, b in places if (a, b) != (i, j)], default=0) for i, j in places]


def index(strings):
    return RunLengthIndex(np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64))


def test_matching_statistics_against_brute_force():
    rnd = random.Random(1)
    for t in range(150):
        strings = [bytes(rnd.choice([0, 1, 255] if t % 2 else [97, 98]) for _ in range(rnd.randrange(25))) for _ in range(rnd.randrange(1, 6))]
        if t % 3 == 0:
            strings += [strings[0], strings[0] + b"a" * 20]
        assert index(strings).matching_statistics().tolist() == longest_elsewhere(strings)


def test_transform_runs():
    """Runs spell the symbols before the sorted suffixes; repeats make few of them."""
    strings = [b"abracadabra" * 40, b"abracadabra" * 39]
    ix = index(strings)
    assert ix.run_length.sum() == len(ix.text) and len(ix.run_length) < 60
    text = "".join(chr(x) if x else "\0" for x in ix.text.tolist())
    spelt = np.repeat(ix.run_symbol, ix.run_length)
    assert sorted(x for x in spelt.tolist() if x > 0) == sorted(ord(c) for c in text[:-1] if c != "\0")


def brute(texts, length):
    """The removed runs and digest of each text, from a table of all windows."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for i, r in enumerate(raws):
        for j in range(len(r) - length + 1):
            seen.setdefault(r[j : j + length], []).append((i, j))
    gone = [np.zeros(len(r) + 1, bool) for r in raws]
    for at in seen.values():
        for i, j in at if len(at) > 1 else []:
            gone[i][j : j + length] = True
    out = []
    for r, g in zip(raws, gone):
        starts = np.flatnonzero(g & ~np.concatenate([[False], g[:-1]]))
        kept = bytes(np.frombuffer(r, np.uint8)[~g[:-1]]) if r else b""
        out.append((len(r), int(g.sum()), len(starts), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["an", "é", "ou", "ti", "😀", "lo", "se"]) for _ in range(rnd.randrange(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(30) for _ in range(3)]
    texts = []
    for i in range(n):
        parts = [prose(rnd.randrange(0, 40))]
        if i % 3:
            parts += [rnd.choice(shared), prose(rnd.randrange(0, 20))]
        if i % 5 == 0:
            parts += [rnd.choice(shared)] * 2
        texts.append(" ".join(parts))
    texts += [texts[4], texts[4], texts[5] + "x", None, "", "short", "ab" * 300, "a" * 500, "a" * 39, texts[7][3:-5]]
    return texts


def run(spark, texts, length, **how):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = sorted(sd.repeat_figures(docs, length, **how).collect(), key=lambda r: r.doc_id)
    return [tuple(r[c] for c in RUNS) for r in rows]


@pytest.mark.parametrize("length,gram,how", [
    (40, 12, {}),
    (40, 12, {"bucket": 1, "offsets": 5}),  # every bucket is dealt again
    (60, 20, {"bucket": 3, "block": 200, "piece": 150, "offsets": 7}),  # texts in pieces, many blocks
    (33, 33, {}),
])
def test_against_brute_force(spark, length, gram, how):
    texts = corpus(length)
    assert run(spark, texts, length, gram=gram, **how) == brute(texts, length)


def test_large_bucket_of_edges(spark):
    """A passage in many texts: its edges are buckets of many different passages."""
    rnd = random.Random(5)
    noise = lambda k: "".join(rnd.choice("abcdefgh") for _ in range(k))
    passage = noise(130)
    texts = [noise(60) + passage + noise(60) for _ in range(80)] + [texts_ + passage[:70] for texts_ in (noise(50), noise(50))]
    want = brute(texts, 50)
    assert run(spark, texts, 50, gram=16, bucket=10, offsets=6) == want
    assert run(spark, texts, 50, gram=16) == want


def test_odd_rows(spark, odd, no_docs):
    got = sd.repeat_figures(odd)
    assert got.columns == ["doc_id", *RUNS]
    rows = odd.select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted([(r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], 400))], key=key)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert sd.repeat_figures(no_docs).count() == 0


def test_remaining_bytes_and_columns(spark):
    texts = ["x" * 30 + "0123456789" * 5, "y" * 9 + "0123456789" * 5, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("z") for c in ("k1", "kept", "row", "marks", "n")})
    rows = {r.row.doc_id: r for r in sd.remove_repeats(docs, 20, gram=8).collect()}
    assert rows[0].row.kept == rows[0].row.row == "z"
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = [(r.start, r.end) for r in rows[i].removed]
        assert bytes(rows[i].kept) == sd._kept(raw, gone)
        assert [len(raw), sum(b - a for a, b in gone), len(gone)] == list(brute(texts, 20)[i][:3])


def test_ranges():
    assert ranges(np.array([1, 2, 3, 7, 9, 10])) == [(1, 3), (7, 7), (9, 10)] and ranges(np.array([])) == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(sd.op11_suffix_dedup(spark, sf).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [d.doc_id for d in docs]
    assert [tuple(r[c] for c in RUNS) for r in got] == brute([d.text for d in docs], 400)
