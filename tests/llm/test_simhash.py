"""Fingerprints and groups against plain Python, every block choice, hot keys dealt over cells."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import simhash as sh
from parley.llm.components import components


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    """Smallest id of each row's group; rows are (id, fingerprint)."""
    fps = np.array([f for _, f in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4):
            parent[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if d is not None or r in least and least[r] is not None else None
    return [least[find(i)] for i in range(len(rows))]


def test_query_against_brute_force(spark, sf, docs):
    got = {r.doc_id: r for r in sh.op2_simhash(spark, sf).collect()}
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    assert all(got[d].fingerprint == f"{f:016x}" for d, f in rows)
    assert [got[d].component_id for d, _ in rows] == groups(rows)


def near_sets(rnd):
    """Fingerprints in tight groups, chains of four-bit steps, and apart."""
    out = []
    for _ in range(6):
        at = rnd.getrandbits(64)
        for _ in range(25):
            x = at
            for b in rnd.sample(range(64), rnd.randrange(0, 5)):
                x ^= 1 << b
            out.append(x)
    x = rnd.getrandbits(64)
    for _ in range(20):
        for b in rnd.sample(range(64), 4):
            x ^= 1 << b
        out.append(x)
    return sorted(set(out + [rnd.getrandbits(64) for _ in range(40)] + [0, 15, (1 << 64) - 1]))


@pytest.mark.parametrize("blocks,cell_rows", [(5, 2000), (6, 3), (7, 2000), (8, 5)])
def test_links_connect_exactly_the_near_ones(spark, blocks, cell_rows):
    fps = near_sets(random.Random(blocks))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = sh.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), blocks=blocks, cell_rows=cell_rows)
    assert links.count() < 15 * 8 * len(fps)
    root = {r.node: r.root for r in components(links).collect()}
    want = groups(list(zip(signed, fps)))
    by = Counter()
    first = {}
    for s, w in zip(signed, want):
        r = root.get(s, s)
        assert first.setdefault(w, r) == r
        by[r] += 1
    assert len(by) == len(first)


def test_majority_counts_over_long_texts():
    h = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2)
    bounds = np.array([0, 0, 1, 3, 700, 700, 2000])
    want = []
    for a, b in zip(bounds, bounds[1:]):
        want.append(sum(1 << i for i in range(64) if 2 * int(((h[a:b] >> np.uint64(i)) & np.uint64(1)).sum()) > b - a))
    assert sh.majority(h, bounds).tolist() == want


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(spark, odd, no_docs):
    from tests.llm.conftest import odd_rows

    got = sh.near_groups(odd).collect()
    rows = [(r[0], fingerprint(r[1])) for r in odd_rows()]
    unsigned = lambda x: x & ((1 << 64) - 1)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, unsigned(r.fp)) for r in got), key=key) == sorted(rows, key=key)
    want = dict(zip(rows, groups(rows)))
    assert all(r.component_id == want[r.doc_id, unsigned(r.fp)] for r in got)
    kept = sh.keep_one(odd)
    assert kept.columns == odd.columns and {r.text_key for r in kept.collect()} == {"x"}
    assert kept.count() == len(set(groups([(f, f) for _, f in rows])))
    assert kept.where("doc_id = 300").count() == 1
    assert sh.near_groups(no_docs).count() == 0 and sh.keep_one(no_docs).count() == 0


def test_kept_documents_are_the_smallest_of_their_groups(spark, docs):
    groups_ = sh.near_groups(docs)
    kept = sh.keep_one(docs)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r[0] for r in groups_.select("component_id").distinct().collect())
    assert kept.join(docs.select("doc_id", F.col("text").alias("own")), "doc_id").where("text <> own").count() == 0


def test_near_copies_without_ids_are_one_group(spark):
    rnd = random.Random(2)
    words = [rnd.choice("abcdefgh") * rnd.randrange(1, 9) for _ in range(400)]
    texts = [" ".join(words)]
    while len(texts) < 3:  # chains of near texts, each with a fingerprint of its own
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(1000)}"
        if 1 <= (fingerprint(" ".join(words)) ^ fingerprint(texts[-1])).bit_count() <= 4:
            texts.append(" ".join(words))
    rows = [(None, t) for t in texts] + [(None, "something else altogether"), (None, texts[0])]
    kept = sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 2 and sum(r.text in texts for r in kept) == 1
    with_ids = sh.keep_one(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in with_ids.collect()) == [0, 3]
