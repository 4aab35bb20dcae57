import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from parley.llm import prefix_trie as pt
from parley.llm.scan import scan, sorted_parts

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute(rows, rebuild=True):
    """The nodes by plain dictionaries; rows of equal turn must be equal."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        full[c] = own.get(first, [])[:h] + v[h:]
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) if below else 1
        saved[path] = sum(saved[x] for x in below) + (len(members[path]) - 1) * (words(path[-1][1]) if path else 0)
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(full[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), parent, len(m), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[:2])


def built(spark, rows, size=pt.SLICE, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return rows_of(pt.trie(*pt.rebuilt(pt.numbered(df)), size=size))


def conversations(seed, n=60):
    rnd = random.Random(seed)
    texts = ["hello there", "hello", "", "a b  c\td", None, "é x"]
    return [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(texts)) for c in rnd.sample(range(-45, 90), n) for t in rnd.sample(range(12), rnd.randrange(1, 7))]


@pytest.mark.parametrize("seed,size", [(1, pt.SLICE), (2, 5), (3, 1)])
def test_against_brute_force(spark, seed, size):
    rows = conversations(seed)
    assert built(spark, rows, size) == brute(rows)


def test_one_long_conversation(spark):
    """A hot conversation spans parts, slices and many jumps."""
    rows = [(40, t, "user", f"turn {t % 7}") for t in range(600)] + [(c, t, "user", f"turn {t}") for c in range(41, 60) for t in range(3)]
    assert built(spark, rows, 16) == brute(rows)


def test_common_conversation_and_first_turn(spark):
    rows = [(c, t, "user", x) for c in range(0, 400) for t, x in enumerate(["hi", "how are you", "fine"][: 1 + c % 3])]
    rows += [(c, 0, "user", "hi") for c in range(400, 440)] + [(c, 1, "user", f"only {c}") for c in range(400, 440)]
    assert built(spark, rows, 32) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (5, None, "user", "null turn first"), (5, 1, None, None), (5, 1, None, None), (5, 1, "", ""), (20, None, None, "w " * 50_000), (2**62, 3, "user", "x"), (-(2**62), 3, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("place", "a", "p", "depth", "c", "position", "words", "_part", "one")})
    assert rows_of(pt.trie(*pt.rebuilt(pt.numbered(df)))) == brute(rows)
    # its first turns come from a conversation that is not there, and it has no others
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    assert built(spark, [(alone, 0, "user", "x")]) == brute([(alone, 0, "user", "x")]) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_empty(spark):
    got = pt.trie(*pt.rebuilt(pt.numbered(spark.createDataFrame([], SCHEMA))))
    assert got.count() == 0 and got.columns == COLUMNS


def test_without_rebuilding(spark):
    rows = conversations(9, 30)
    turns = pt.numbered(spark.createDataFrame(rows, SCHEMA)).withColumn("source", F.lit(0).cast("long"))
    assert rows_of(pt.trie(turns, turns.select("conv_id").distinct())) == brute(rows, rebuild=False)


def test_scan_over_parts(spark):
    rnd = random.Random(4)
    rows = sorted((rnd.choice([1, 1, 1, 2, 5]), i, rnd.randrange(-9, 9)) for i in range(500))
    parts = sorted_parts(spark.createDataFrame(rows, "k long, i long, v long").repartition(7), ["k", "i"])
    got = scan(parts, ["k"], sums={"s": "v"}, sums_before={"s0": "v"}, firsts={"f": "v"}, after={"n": "i"}).collect()
    total, first = {}, {}
    want = []
    for j, (k, i, v) in enumerate(rows):
        before = total.get(k, 0)
        total[k] = before + v
        want.append((k, i, v, total[k], before, first.setdefault(k, v), rows[j + 1][1] if j + 1 < len(rows) else None))
    assert sorted((r.k, r.i, r.v, r.s, r.s0, r.f, r.n) for r in got) == sorted(want)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(pt.op12_prefix_trie(spark, sf)) == brute(rows)
