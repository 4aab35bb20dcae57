"""Targets, quotas and takings against plain Python."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parley.llm import mixing as mx


def plain_targets(sizes):
    """Targets by resharing the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = [s for s in free if target[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target
        capped |= set(over)


def plain_seats(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        if votes[i] <= 0:
            break
        got[i] += 1
    return got


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(got, rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += words(text)
    target = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(1.5, 0.01 * t), (s, taken[s], t)


def test_query_against_plain_python(spark, sf, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    plan = mx.op5_mixing(spark, sf)
    got = plan.join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(got) == len(rows)
    size = {d: words(t) for d, t, _ in rows}
    assert all(size[r.doc_id] == r["size"] for r in got)
    check(got, rows)
    again = {r.doc_id: r.taken for r in mx.op5_mixing(spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in got}


@pytest.mark.parametrize("shard_rows", [7, 50])
def test_many_shards_of_a_hot_source(spark, shard_rows):
    rnd = random.Random(shard_rows)
    rows = [(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 90))), rnd.choice(["hot", "hot", "hot", "a", "b", None, "c", "é", "Z"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mx.plan_mix(df, shard_rows=shard_rows).collect(), rows)


def test_apportionment_equals_seat_by_seat(spark):
    rnd = random.Random(9)
    for trial in range(4):
        votes = [rnd.choice([0, 1, 7, 7, 100, rnd.randrange(1, 5000)]) for _ in range(rnd.randrange(1, 12))]
        seats = rnd.randrange(0, 60)
        df = spark.createDataFrame([(g, i, float(v)) for g in (1, 2) for i, v in enumerate(votes)], "g int, i int, v double")
        got = mx.sainte_lague(df, "v", ["i"], F.lit(seats), ["g"], "seats").orderBy("g", "i").collect()
        assert [r.seats for r in got] == plain_seats(votes, seats) * 2, (votes, seats)


def test_copies_follow_takings(spark, docs):
    plan = mx.plan_mix(docs)
    taken, copied = plan.groupBy("source").agg(F.sum("taken").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("c")).agg(F.sum("t"), F.sum("c")).first()
    assert abs(taken - copied) < 0.1 * taken
    mixed = mx.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == plan.agg(F.sum("copies")).first()[0]
    want = {(r.doc_id, r.copies) for r in plan.where("copies > 0").collect()}
    assert {(r.doc_id, r["count"]) for r in mixed.groupBy("doc_id").count().collect()} == want
    assert mixed.exceptAll(mx.mix(docs)).count() == 0


@pytest.mark.parametrize("shard_rows", [9, 4000])
def test_mixed_words_meet_targets_with_long_documents(spark, shard_rows):
    rnd = random.Random(shard_rows)
    rows = [(i, "".join(rnd.choice(["", " "]) if not j else f"w{i}x{j}" + rnd.choice([" ", "\n", " \t "]) for j in range(rnd.randrange(1, 40))), "abcd"[i % 4]) for i in range(200)]
    rows += [(1000 + i, " ".join(f"v{i}x{j}" for j in range(3000)), source) for i, source in enumerate("abcd")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, got, texts = defaultdict(int), defaultdict(int), {d: t for d, t, _ in rows}
    for _, text, source in rows:
        sizes[source] += words(text)
    for r in mx.mix(df, shard_rows=shard_rows).collect():
        got[r.source] += words(r.text)
        assert r.text and texts[r.doc_id].startswith(r.text)
    for s, t in plain_targets(sizes).items():
        assert abs(got[s] - t) <= max(1.5, 0.01 * t), (s, got[s], t)


def test_odd_rows(spark, odd, no_docs):
    from tests.llm.conftest import odd_rows

    rows = [(r[0], r[1], r[3]) for r in odd_rows()]
    got = mx.plan_mix(odd).collect()
    assert len(got) == len(rows)
    check(got, rows)
    mixed = mx.mix(odd)
    assert mixed.columns == odd.columns and {r._n for r in mixed.collect()} == {"x"} and mixed.count() == sum(r.copies for r in got)
    assert mx.plan_mix(no_docs).count() == 0 and mx.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mx.plan_mix(blank).collect()] == [(0, 0.0)] * 2


def test_no_python_in_the_plan(spark, docs):
    plan = mx.mix(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
