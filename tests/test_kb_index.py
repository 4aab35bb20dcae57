"""The stored index against the plain search; one-pass dispatch against filters."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators import kb, kb_index, tools
from parley.plans import catalog
from parley.sources import kb_files
from sf_dirs import SF001

SECTIONS = "doc_id long, section_no long, source string, content string"


def corpus(n=150):
    rnd = random.Random(4)
    common, words = ["the", "a", "of"], [f"w{i}" for i in range(60)]
    return [(i, j, f"f{i % 7}.txt", " ".join(rnd.choices(common, k=rnd.randrange(6)) + rnd.choices(words, k=rnd.randrange(8)))) for i in range(n) for j in range(1 + i % 2)]


def asked(spark):
    rnd = random.Random(5)
    texts = ["the", "the a of", "nothing here", "", None, "w1"] + [" ".join(rnd.choices(["the", "a", "of"], k=2) + rnd.choices([f"w{i}" for i in range(60)], k=rnd.randrange(1, 9))) for _ in range(40)]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_search_equals_plain_search(spark):
    data, queries = corpus(), asked(spark)
    index = kb_index.Index(spark, tempfile.mkdtemp(prefix="parley-kb-"), T.LongType(), buckets=4)
    index.add(spark.createDataFrame(data[:80], SECTIONS), 0)
    index.add(spark.createDataFrame(data, SECTIONS), 1)  # all again: only the new ones are taken
    assert index._every().where("batch = 1").select("doc_id").distinct().count() < 150
    index.add(spark.createDataFrame(data, SECTIONS), 1)  # the same batch once more
    sections = spark.createDataFrame(data, SECTIONS)
    assert rows(index.sections()) == rows(sections)
    want = rows(kb.topk(queries, sections))
    for often in (0, 5, 40, 10_000):  # which tokens are joined first changes nothing
        assert rows(index.topk(queries, often=often)) == want, often
    # a changed document replaces its sections
    changed = [(3, 0, "f3.txt", "w1 w1 zebra")]
    index.add(spark.createDataFrame(changed, SECTIONS), 2)
    now = spark.createDataFrame([r for r in data if r[0] != 3] + changed, SECTIONS)
    assert rows(index.topk(queries, often=5)) == rows(kb.topk(queries, now))
    assert rows(index.search(queries.where("query_id = 5")).select("content")) == rows(kb.search(queries.where("query_id = 5"), now).select("content"))


def test_folder_and_empty_index(spark):
    index = kb_index.Index(spark, tempfile.mkdtemp(prefix="parley-kb-"))
    assert index.topk(asked(spark)).count() == 0
    folder = tempfile.mkdtemp(prefix="parley-faq-")
    with open(f"{folder}/faq.txt", "w") as f:
        f.write("Title\n\nq: w1 where\n\na: there w1\n")
    sections = kb_files.read_kb_files(spark, folder)
    index.add(sections, 0)
    assert rows(index.topk(asked(spark))) == rows(kb.topk(asked(spark), sections))


def test_postings_are_stored_by_section_and_met_without_a_join(spark):
    """A section's tokens of a bucket are one stored row, and an index without replaced documents joins no postings with their batches."""
    index = kb_index.Index(spark, tempfile.mkdtemp(prefix="parley-kb-"), T.LongType(), buckets=2)
    index.add(spark.createDataFrame([(i, 0, "f", " ".join(f"w{j}" for j in range(30))) for i in range(5)], SECTIONS), 0)
    assert spark.read.parquet(f"{index.path}/postings").count() == 10
    plan = index._current(index._every())._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.fixture(scope="module")
def triaged(spark):
    df = catalog.triaged(spark, SF001)
    return spark.createDataFrame(df.where("message_id < 400").collect(), df.schema)


def test_dispatch_once_equals_filters(spark, triaged):
    seen = {}

    def tool(name):
        def run(df):
            seen[name] = df
            return df.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))

        return run

    steps = [r.next_step for r in tools.with_next_step(triaged).select("next_step").distinct().collect()]
    registry = tools.ToolRegistry()
    registry.register_tools({s: tool(s) for s in steps})
    path = tempfile.mkdtemp(prefix="parley-dispatch-")
    got = tools.dispatch_once(triaged, registry, path)
    plain = tools.dispatch(triaged, registry)
    for s in steps:
        assert rows(seen[s].select(*plain[s].columns)) == rows(plain[s])
        assert rows(got[s]) == rows(plain[s].groupBy("intent").agg(F.count(F.lit(1)).alias("n")))
    # the rows are read from the written folders: no tool runs the triage again
    assert all("LocalTableScan" not in d._jdf.queryExecution().toString() for d in seen.values())
    tools.dispatch_once(triaged, registry, path)
    assert sum(d.count() for d in seen.values()) == triaged.where("not escalated").count()
