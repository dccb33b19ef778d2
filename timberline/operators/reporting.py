"""Report tables derived from bucket counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import attributes, instants
from timberline.schema import LEVELS, OTHER, RANGE_PRESET_MS, TOP_SERVICES

# Request messages and the widest range per bucket size.
BAD_RANGE = "Choose valid start and end times."
EMPTY_RANGE = "The end time must be after the start time."
BUCKET_UP_TO_MS = (("1m", 7_200_000), ("5m", 43_200_000), ("1h", 604_800_000))
WIDEST_BUCKET = "1d"


def top_services(counted: DataFrame, n: int = TOP_SERVICES) -> DataFrame:
    """The ``n`` largest groups by total, ties by name."""
    totals = counted.where(F.col("group").isNotNull()).groupBy("group").agg(F.sum("count").alias("count"))
    return totals.orderBy(F.desc("count"), F.asc("group")).limit(n)


def level_series(counted: DataFrame) -> DataFrame:
    """One row per bucket: a column per level, missing ones 0, and the total."""
    wide = counted.groupBy("start").agg(*_sums("group", LEVELS))
    return wide.withColumn("total", sum((F.col(level) for level in LEVELS[1:]), F.col(LEVELS[0])))


def _sums(key: str, values) -> list[Column]:
    return [
        F.coalesce(F.sum(F.when(F.col(key) == value, F.col("count"))), F.lit(0)).alias(str(value))
        for value in values
    ]


def level_rows(counted: DataFrame) -> DataFrame:
    """``level_series`` in long form: ``start, series, series_no, value``."""
    return _long(level_series(counted), {no: level for no, level in enumerate(LEVELS, 1)}).withColumnRenamed(
        "name", "series"
    )


def _long(wide: DataFrame, columns: dict[int, str]) -> DataFrame:
    rows = [
        F.struct(F.lit(name).alias("name"), F.lit(no).alias("series_no"), F.col(name).alias("value"))
        for no, name in columns.items()
    ]
    return wide.select("start", F.explode(F.array(*rows)).alias("r")).select("start", "r.*")


def service_series(counted: DataFrame, n: int = TOP_SERVICES) -> DataFrame:
    """``start, series, series_no, value``: the top groups, and the rest as one more series if any.

    Every series has a value in every bucket, 0 when it had no rows there. The ranking is ``n + 1``
    rows, which bounds the window and both broadcasts; it tells whether there is a rest at all.
    """
    ranked = top_services(counted, n + 1).withColumn(
        "series_no", F.row_number().over(Window.orderBy(F.desc("count"), F.asc("group")))
    )
    top = ranked.where(F.col("series_no") <= n).select("group", "series_no")
    names = ranked.select(
        "series_no", F.when(F.col("series_no") <= n, F.col("group")).otherwise(OTHER).alias("series")
    )
    numbered = counted.where(F.col("group").isNotNull()).join(F.broadcast(top), "group", "left").select(
        "start", "count", F.coalesce("series_no", F.lit(n + 1)).alias("series_no")
    )
    wide = numbered.groupBy("start").agg(*_sums("series_no", range(1, n + 2)))
    filled = _long(wide, {no: str(no) for no in range(1, n + 2)}).drop("name")
    named = filled.join(F.broadcast(names), "series_no")
    # A group that itself carries the name of the rest shares its series.
    return named.groupBy("start", "series").agg(
        F.min("series_no").alias("series_no"), F.sum("value").alias("value")
    )


def stack_offsets(series: DataFrame) -> DataFrame:
    """Add ``offset``: the summed values of the earlier series of the same bucket."""
    earlier = Window.partitionBy("start").orderBy("series_no").rowsBetween(Window.unboundedPreceding, -1)
    return series.withColumn("offset", F.coalesce(F.sum("value").over(earlier), F.lit(0)))


def attribute_preview(logs: DataFrame) -> DataFrame:
    """Add ``preview`` (first attribute as text, NULL without any) and ``more`` (how many others)."""
    first, more = attributes.preview(F.col("attr"))
    return logs.withColumn("preview", first).withColumn("more", more)


def bucket_for(duration_ms: Column) -> Column:
    """The bucket size a report of that length uses."""
    choice = None
    for bucket, limit in BUCKET_UP_TO_MS:
        condition = duration_ms <= limit
        choice = F.when(condition, bucket) if choice is None else choice.when(condition, bucket)
    return F.when(duration_ms.isNotNull(), choice.otherwise(WIDEST_BUCKET))


def resolve_requests(requests: DataFrame, now_ms: Column) -> DataFrame:
    """Resolve a table of report requests on one clock.

    Needs ``range`` (a preset or ``custom``), ``since`` and ``until`` (instants as text). Adds
    ``since_ms, until_ms, bucket`` and ``reason``, which is NULL for a usable request.
    """
    span = F.lit(None).cast("bigint")
    for preset, ms in RANGE_PRESET_MS.items():
        span = F.when(F.col("range") == preset, F.lit(ms).cast("bigint")).otherwise(span)
    custom = F.col("range") == "custom"
    staged = requests.select(
        "*",
        F.when(custom, instants.instant_millis(F.col("since"))).otherwise(now_ms - span).alias("_since"),
        F.when(custom, instants.instant_millis(F.col("until"))).when(span.isNotNull(), now_ms).alias("_until"),
    )
    reason = F.when(F.col("_since").isNull() | F.col("_until").isNull(), BAD_RANGE).when(
        F.col("_until") <= F.col("_since"), EMPTY_RANGE
    )
    staged = staged.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return staged.select(
        *requests.columns,
        F.when(good, F.col("_since")).alias("since_ms"),
        F.when(good, F.col("_until")).alias("until_ms"),
        F.when(good, bucket_for(F.col("_until") - F.col("_since"))).alias("bucket"),
        "reason",
    )
