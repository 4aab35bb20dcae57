"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row is produced,
nothing is collected to the driver). Before timing, every headline query runs
once on the smallest scale factor (JIT, code generation and expression
building warm-up), so the timings measure the work at $BENCH_SF_DIR rather
than JVM start-up. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parley.plans import catalog  # noqa: E402
from parley.session import local_session  # noqa: E402

HEADLINE = [
    "pii_redact",
    "triage",
    "kb_topk",
    "monitor_rolling",
    "conv_summary",
    "guardrail_resolve",
    "reply_request",
    "alerts",
    "order_format",
    "running_session_cost",
]


def run_one(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="parley-bench")
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm):
        for n in names:
            run_one(spark, n, warm)
    else:
        run_one(spark, "intent_known", sf)
    times = {}
    for n in names:
        times[n] = round(run_one(spark, n, sf), 3)
    from pyspark.sql import functions as F

    from parley.sources import fixtures

    corpus = fixtures.view(spark, sf, "v_pii_corpus").agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    out = {
        "metric": "headline_wall_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""),
        "pii_redact_rows_per_sec": round(corpus[0] / times["pii_redact"], 1) if "pii_redact" in times else None,
        "pii_redact_chars_per_sec": round(corpus[1] / times["pii_redact"]) if "pii_redact" in times else None,
        "warmup": warm if warm and os.path.isdir(warm) else "none",
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
