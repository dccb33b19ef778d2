"""Counts per epoch-aligned time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators.filters import LogFilter, apply_filters
from timberline.schema import BUCKET_MS, GROUPS, MAX_SAFE_COUNT


def group_column(group_by: str | None) -> Column:
    if group_by is None:
        return F.lit(None).cast("string")
    if group_by not in GROUPS:
        raise ValueError("group_by must be service or level")
    return F.col(group_by)


def check_bucket(bucket: str) -> None:
    if bucket not in BUCKET_MS:
        raise ValueError("bucket must be one of: 1m, 5m, 1h, 1d")


def bucket_counts(logs: DataFrame, bucket: str, group_by: str | None = None) -> DataFrame:
    """``start_ms, group, count`` without filter or order: the mergeable partial result."""
    check_bucket(bucket)
    start = instants.bucket_millis(instants.millis(F.col("timestamp")), bucket)
    keyed = logs.select(start.alias("start_ms"), group_column(group_by).alias("group"))
    # Grouping by a NULL literal as well would only widen the key.
    keys = ["start_ms"] if group_by is None else ["start_ms", "group"]
    counted = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    if group_by is None:
        counted = counted.withColumn("group", F.lit(None).cast("string"))
    return counted.select("start_ms", "group", "count")


def present(counted: DataFrame, ordered: bool = True) -> DataFrame:
    """``start, group, count`` in wire form, by start and then group with NULL first."""
    shown = counted.select(
        "start_ms", instants.wire(F.col("start_ms")).alias("start"), "group", safe_count("count").alias("count")
    )
    if ordered:
        shown = shown.orderBy(F.asc("start_ms"), F.asc_nulls_first("group"))
    return shown.drop("start_ms")


def safe_count(name: str) -> Column:
    """A count outside 0..2^53-1 is an error, never a rounded number."""
    value = F.col(name)
    return F.when(value.between(0, MAX_SAFE_COUNT), value).otherwise(
        F.raise_error(F.lit("aggregate count exceeds the safe integer range")).cast("bigint")
    )


def count_by_bucket(
    logs: DataFrame, f: LogFilter, bucket: str, group_by: str | None = None, ordered: bool = True
) -> DataFrame:
    """Count matching rows per bucket; buckets without rows are left out."""
    if f.since is None or f.until is None:
        raise ValueError("since and until are required")
    return present(bucket_counts(apply_filters(logs, f), bucket, group_by), ordered)


def totals(counted: DataFrame) -> DataFrame:
    """``total`` and ``peak`` (largest bucket total, 0 without buckets) of a counted frame."""
    per_bucket = counted.groupBy("start").agg(F.sum("count").alias("n"))
    return per_bucket.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("peak"),
    )


def error_share(counted_by_level: DataFrame) -> DataFrame:
    """Errors over all counted rows, NULL without rows."""
    errors = F.sum(F.when(F.col("group") == "error", F.col("count")).otherwise(0))
    return counted_by_level.agg(
        F.try_divide(errors.cast("double"), F.sum("count").cast("double")).alias("error_share")
    )


def distinct_starts(counted: DataFrame) -> DataFrame:
    return counted.select("start").distinct().orderBy("start")
