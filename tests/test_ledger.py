"""The stored ledger equals the plans over the whole table."""

import random
import tempfile

from pyspark.sql import functions as F

from parley.operators import cost, ledger

CALLS = "session_id long, seq long, agent string, input_tokens long, output_tokens long"


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_appended_batches_equal_the_whole_table(spark):
    rnd = random.Random(6)
    calls = [(rnd.choice([1, 2, 3, None]), i, rnd.choice([cost.AGENT_REPLY, cost.AGENT_INTENT, None]), rnd.randrange(2000), rnd.randrange(500)) for i in range(200)]
    root = tempfile.mkdtemp(prefix="parley-ledger-")
    frames = [spark.createDataFrame(calls[a:b], CALLS) for a, b in ((0, 70), (70, 71), (71, 200))]
    for i, f in enumerate(frames):
        ledger.append(f, i, root)
    ledger.append(frames[2], 2, root)  # once more: nothing is counted twice
    ledger.append(spark.createDataFrame([], CALLS), 3, root)
    whole = spark.createDataFrame(calls, CALLS)
    money = "decimal(38,12)"
    want = cost.running_session_cost(whole).select("session_id", "seq", F.col("session_cost").cast(money))
    assert rows(ledger.running(spark, root).select("session_id", "seq", "session_cost")) == rows(want) and want.count() > 40
    assert rows(ledger.session_totals(spark, root)) == rows(cost.session_cost(whole).select("session_id", F.col("total_cost").cast(money), "calls"))
    assert rows(ledger.displayed(spark, root)) == rows(cost.displayed_cost(whole).select("session_id", F.col("displayed_cost").cast(money), F.col("true_cost").cast(money)))


def test_empty_ledger(spark):
    root = tempfile.mkdtemp(prefix="parley-ledger-")
    assert ledger.running(spark, root).count() == ledger.session_totals(spark, root).count() == 0
