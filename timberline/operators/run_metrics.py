"""Summaries of a measured run: latencies, reconciliation, limits, resources, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators.numbering import exact_quantiles

QUANTILES = {"med": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
_APPROX_ACCURACY = 10_000


def latency_summary(df: DataFrame, value: str, exact: bool = True) -> DataFrame:
    """``avg, min, med, p90, p95, p99, max`` of a duration column, in one row.

    Ranks are true and interpolated; the distinct values are sorted in parallel. Without ``exact`` a bounded
    sketch estimates them.
    """
    basics = [F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max")]
    if not exact:
        sketch = F.percentile_approx(value, list(QUANTILES.values()), _APPROX_ACCURACY).alias("q")
        return df.agg(*basics, sketch).select(
            "avg", "min", *[F.col("q")[i].alias(name) for i, name in enumerate(QUANTILES)], "max"
        )
    one = df.agg(*basics).withColumn("_one", F.lit(1))
    quantiles = exact_quantiles(df, value, QUANTILES).withColumn("_one", F.lit(1))
    return one.join(quantiles, "_one").select("avg", "min", *QUANTILES, "max")


def ingest_reconcile(offered: DataFrame, summaries: DataFrame, stored: DataFrame) -> DataFrame:
    """Per run: offered, accepted, rejected and stored rows, missing rows and the batch success rate.

    ``offered``: ``run_id, batch_id, offered``; ``summaries``: ``batch_id, accepted, rejected_count``;
    ``stored``: ``run_id, stored``. A batch succeeds when every entry offered was accepted.
    """
    answered = offered.join(summaries.select("batch_id", "accepted", "rejected_count"), "batch_id", "left")
    accepted = F.coalesce("accepted", F.lit(0))
    runs = answered.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("offered").alias("offered"),
        F.sum(accepted).alias("accepted"),
        F.sum(F.coalesce("rejected_count", F.lit(0))).alias("rejected"),
        F.avg(F.when(accepted == F.col("offered"), 1.0).otherwise(0.0)).alias("success_rate"),
    )
    joined = runs.join(stored, "run_id", "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("batches", "offered", "accepted", "rejected", "stored")}
    return joined.select(
        "run_id", *zero.values(),
        (F.coalesce("accepted", F.lit(0)) - F.coalesce("stored", F.lit(0))).alias("missing"),
        "success_rate",
    )


def metric_rows(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A wide summary as ``*keys, metric, value`` rows."""
    keys = keys or []
    names = [c for c in summary.columns if c not in keys]
    pairs = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
    ])
    return summary.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*")


def slo_check(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Judge ``metric, value`` rows by ``metric, op, bound`` rules; an absent metric fails its rule."""
    value, bound = F.col("value"), F.col("bound")
    holds = (
        F.when(F.col("op") == "<", value < bound)
        .when(F.col("op") == "<=", value <= bound)
        .when(F.col("op") == ">", value > bound)
        .when(F.col("op") == ">=", value >= bound)
        .when(F.col("op") == "==", value == bound)
    )
    return rules.join(metrics, "metric", "left").withColumn("passed", F.coalesce(holds, F.lit(False)))


def resource_summary(samples: DataFrame) -> DataFrame:
    """Average and maximum CPU and memory per container."""
    return samples.groupBy("container").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("cpu_percent").alias("avg_cpu_percent"),
        F.max("cpu_percent").alias("max_cpu_percent"),
        F.avg("memory_bytes").alias("avg_memory_bytes"),
        F.max("memory_bytes").alias("max_memory_bytes"),
        F.max("memory_percent").alias("max_memory_percent"),
    )


def throughput(df: DataFrame, at: Column, keys: list[str] | None = None, amount: Column | None = None) -> DataFrame:
    """Records per second between the first and last instant, NULL when they coincide."""
    ms = instants.millis(at)
    records = F.sum(amount) if amount is not None else F.count(F.lit(1))
    seconds = (F.max(ms) - F.min(ms)) / F.lit(1000.0)
    return df.groupBy(*(keys or [])).agg(records.alias("records"), seconds.alias("seconds")).withColumn(
        "per_second", F.try_divide(F.col("records").cast("double"), F.col("seconds"))
    )
