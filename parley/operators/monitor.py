"""Health monitor: count-based rolling metrics over the interaction stream,
alerts and the dashboard.

Order is (ts, event_id). The window is the current interaction and the 99
before it; it is filled from the start, so early rows see fewer rows (no
minimum sample). The global (un-keyed) monitor uses the halo plan from
``parley.plans.windows``; a keyed monitor partitions by its key instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.plans.windows import rolling_global, rolling_naive

# Window sizes, thresholds, baselines, alert texts.
WINDOW_SIZE = 100
SENTIMENT_SPIKE_WINDOW = 10
ESCALATION_RATE_LIMIT = 0.30
SENTIMENT_SPIKE_LIMIT = 0.3
COST_SPIKE_FACTOR = 5
BASELINES = {"escalation_rate": 0.15, "avg_sentiment": 0.6, "avg_cost": 0.008, "pii_success_rate": 0.99}
COST_LIMIT = BASELINES["avg_cost"] * COST_SPIKE_FACTOR
DEFAULTS = {"pii_filter_success": True, "escalated": False, "sentiment_score": 0.5, "response_time_ms": 0, "cost": 0.0}
TITLE_PII = "PII Filter Failure"
TITLE_ESCALATION = "High Escalation Rate"
TITLE_SENTIMENT = "Negative Sentiment Spike"
TITLE_COST = "Cost Spike"
MESSAGE_PII = "PII filter failed to process message"

ORDER = ["ts", "event_id"]


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing fields filled in. ``record`` is the interaction as it came, a JSON object of the fields it has, where a rule of the row alone fires (null elsewhere)."""
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in DEFAULTS.items()}
    if "record" in df.columns:
        return df.withColumns(filled)
    given = [c for c in DEFAULTS if c in df.columns]
    asis = df.select("*", F.struct(*given).alias("_given")) if given else df.withColumn("_given", F.lit(None).cast("struct<none:int>"))
    out = asis.withColumns(filled)
    fires = ~F.col("pii_filter_success") | (F.col("cost") > COST_LIMIT)
    return out.withColumn("record", F.when(fires, F.to_json("_given"))).drop("_given")


# Averages of scores and costs are exact: values are decimals of ten places and
# frame sums are decimal sums, so thresholds and rounding do not depend on
# summation order or on how the frame is partitioned.
VALUE_TYPE = "decimal(28,10)"


def _exact(c: str) -> Column:
    return F.col(c).cast(VALUE_TYPE)


def _sum_specs() -> dict[str, tuple[int, Column]]:
    n = WINDOW_SIZE
    return {
        "_s_esc": (n, F.col("escalated").cast("long")),
        "_s_pii": (n, F.col("pii_filter_success").cast("long")),
        "_s_sent": (n, _exact("sentiment_score")),
        "_s_cost": (n, _exact("cost")),
        "_s_recent": (SENTIMENT_SPIKE_WINDOW, _exact("sentiment_score")),
    }


def _mean(total: str, n: Column) -> Column:
    return (F.col(total) / n.cast("decimal(10,0)")).cast("double")


def _finish(df: DataFrame, rn: str) -> DataFrame:
    n = F.least(F.col(rn), F.lit(WINDOW_SIZE)).cast("long")
    n10 = F.least(F.col(rn), F.lit(SENTIMENT_SPIKE_WINDOW)).cast("long")
    return df.withColumns(
        {
            "window_n": n,
            "escalation_rate": F.col("_s_esc") / n,
            "pii_success_rate": F.col("_s_pii") / n,
            "avg_sentiment": _mean("_s_sent", n),
            "avg_cost": _mean("_s_cost", n),
            "recent_sentiment": _mean("_s_recent", n10),
        }
    ).drop("_s_esc", "_s_pii", "_s_sent", "_s_cost", "_s_recent")


def rolling(interactions: DataFrame, plan: str = "halo", block: int = 1 << 16, key: str | None = None) -> DataFrame:
    """Rolling metrics per interaction. ``plan``: ``halo`` (parallel), ``keyed``
    (one monitor per ``key``) or ``naive`` (one global window, one task: a
    plain statement of the result for tests)."""
    df = with_defaults(interactions)
    if plan == "keyed":
        out = rolling_global(df, ORDER, {}, block=block, exact_sums=_sum_specs(), keys=[key])
    elif plan == "naive":
        out = rolling_naive(df, ORDER, {}, _sum_specs())
    else:
        out = rolling_global(df, ORDER, {}, block=block, exact_sums=_sum_specs())
    return _finish(out, "_rn").drop("_rn")


def _pct1(x: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(x * 100, 1))


def _details(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _alert(severity: str, title: str, message: Column, details: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(title).alias("title"), message.alias("message"), details.alias("details"))


def pii_alert() -> Column:
    """Of the row alone: null unless redaction failed."""
    return F.when(~F.col("pii_filter_success"), _alert("CRITICAL", TITLE_PII, F.lit(MESSAGE_PII), F.col("record")))


def cost_alert() -> Column:
    """Of the row alone: null unless the interaction cost five times the usual."""
    message = F.concat(F.lit("Single interaction cost: $"), F.format_string("%.4f", F.bround(F.col("cost"), 4)))
    return F.when(F.col("cost") > COST_LIMIT, _alert("WARNING", TITLE_COST, message, F.col("record")))


def escalation_alert() -> Column:
    message = F.concat(
        F.lit("Escalation rate at "), _pct1(F.col("escalation_rate")),
        F.lit(" (baseline: "), _pct1(F.lit(BASELINES["escalation_rate"])), F.lit(")"),
    )
    details = _details(F.round("escalation_rate", 9).alias("current_rate"))
    return F.when(F.col("escalation_rate") > ESCALATION_RATE_LIMIT, _alert("WARNING", TITLE_ESCALATION, message, details))


def sentiment_alert() -> Column:
    message = F.concat(F.lit("Recent average sentiment: "), F.format_string("%.2f", F.bround(F.col("recent_sentiment"), 2)))
    details = _details(F.round("recent_sentiment", 9).alias("avg_sentiment"))
    return F.when(F.col("recent_sentiment") < SENTIMENT_SPIKE_LIMIT, _alert("WARNING", TITLE_SENTIMENT, message, details))


def alerts(rolled: DataFrame) -> DataFrame:
    """0-4 alerts per interaction, in rule order (alert_no 0..3 kept dense);
    ``ts`` is the interaction's time, ``details`` a JSON object: the interaction
    as it came for the rules of a row alone, the mean for those of a window."""
    fired = F.filter(F.array(pii_alert(), escalation_alert(), sentiment_alert(), cost_alert()), lambda a: a.isNotNull())
    return rolled.select(*ORDER, F.posexplode(fired).alias("alert_no", "_alert")).select(*ORDER, F.col("alert_no").cast("bigint").alias("alert_no"), "_alert.*")


def row_alerts(interactions: DataFrame, rule: Column) -> DataFrame:
    """Alerts of a rule that looks at single interactions (``pii_alert``, ``cost_alert``): a filter, no window."""
    df = with_defaults(interactions).select(*ORDER, rule.alias("_alert"))
    return df.where(F.col("_alert").isNotNull()).select(*ORDER, "_alert.*")


def dashboard(interactions: DataFrame) -> DataFrame:
    """State after the last interaction: metrics of the last ``WINDOW_SIZE``
    ones (a top-k by time, no window over the table); ``recent_alerts`` counts
    CRITICAL alerts over all time; ``total_interactions`` is the window
    occupancy."""
    df = with_defaults(interactions)
    last = df.orderBy(*[F.col(c).desc() for c in ORDER]).limit(WINDOW_SIZE)
    n = F.count(F.lit(1))
    state = last.agg(
        (F.sum(F.col("escalated").cast("long")) / n).alias("escalation_rate"),
        (F.sum(F.col("pii_filter_success").cast("long")) / n).alias("pii_success_rate"),
        (F.sum(_exact("sentiment_score")) / n.cast("decimal(10,0)")).cast("double").alias("avg_sentiment"),
        n.alias("total_interactions"),
        (F.sum(_exact("cost")) / n.cast("decimal(10,0)")).cast("double").alias("avg_cost"),
    ).where("total_interactions > 0")
    critical = df.where(~F.col("pii_filter_success")).agg(F.count(F.lit(1)).alias("recent_alerts"))
    return state.select(
        "escalation_rate", "pii_success_rate", "avg_sentiment", "total_interactions",
        critical.select("recent_alerts").scalar().alias("recent_alerts"), "avg_cost",
    )


def health_report(dash: DataFrame) -> DataFrame:
    """Long form: (metric, value, baseline); baseline null where none."""
    return dash.select(
        F.explode(
            F.array(
                F.struct(F.lit("total_interactions").alias("metric"), F.col("total_interactions").cast("double").alias("value"), F.lit(None).cast("double").alias("baseline")),
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(BASELINES[b]).cast("double").alias("baseline"))
                    for m, b in [("escalation_rate", "escalation_rate"), ("pii_success_rate", "pii_success_rate"),
                                 ("avg_sentiment", "avg_sentiment"), ("avg_cost", "avg_cost")]
                ],
                F.struct(F.lit("critical_alerts").alias("metric"), F.col("recent_alerts").cast("double").alias("value"), F.lit(None).cast("double").alias("baseline")),
            )
        ).alias("r")
    ).select("r.*")


def recent_alerts(alert_rows: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` alerts in firing order (a top-k report)."""
    return alert_rows.orderBy(F.col("ts").desc(), F.col("event_id").desc(), F.col("alert_no").desc()).limit(n)
