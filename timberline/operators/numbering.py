"""Global row numbers and running totals without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.session import materialise

# Row position inside one partition, below the partition number in ``monotonically_increasing_id``.
_POSITION_BITS = 33


def ranged(df: DataFrame, order: list[Column], label: str, partitions: int | None = None) -> DataFrame:
    """Range-partition and sort by ``order``, then write once.

    Range bounds are sampled, so a second evaluation could cut elsewhere; the written copy fixes each
    row's partition (``_part``) and place in it (``_pos``). ``order`` must end in a unique key: then a
    hot leading value is spread over several ranges instead of one task.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", row)
        .withColumn("_part", F.shiftright("_row", _POSITION_BITS).cast("int"))
        .withColumn("_pos", F.col("_row").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_row")
    )
    return materialise(placed, label)


def part_offsets(placed: DataFrame, weight: Column) -> DataFrame:
    """``_part, _offset, _total``: weight before each range and overall; one row per range."""
    sums = placed.groupBy("_part").agg(F.sum(weight).alias("_weight"))
    # One row per shuffle partition, so the window over all of them is bounded by that setting.
    by_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sums.select(
        "_part",
        F.coalesce(F.sum("_weight").over(by_part), F.lit(0)).alias("_offset"),
        F.sum("_weight").over(everything).alias("_total"),
    )


def numbered(df: DataFrame, order: list[Column], label: str, partitions: int | None = None) -> DataFrame:
    """Add ``row_no`` from 0 in ``order`` and ``row_total``: one range shuffle, no window over rows."""
    placed = ranged(df, order, label, partitions)
    offsets = F.broadcast(part_offsets(placed, F.lit(1)))  # one row per range
    return placed.join(offsets, "_part").select(
        *df.columns,
        (F.col("_offset") + F.col("_pos")).alias("row_no"),
        F.col("_total").alias("row_total"),
    )


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row of exact, linearly interpolated quantiles, named by the keys of ``probabilities``.

    Values are counted before anything is sorted, so a value held by many rows is one row; the counts
    are range-partitioned and running totals locate the two neighbours of every quantile.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    placed = ranged(counts, [F.asc("v")], "quantiles")
    offsets = F.broadcast(part_offsets(placed, F.col("n")))  # one row per range
    running = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = placed.withColumn("_upto", F.sum("n").over(running)).join(offsets, "_part").select(
        "v",
        (F.col("_offset") + F.col("_upto") - F.col("n")).alias("lo"),
        (F.col("_offset") + F.col("_upto")).alias("hi"),
        F.col("_total").alias("total"),
    )

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("lo") <= position) & (position < F.col("hi")), F.col("v")))

    picks = []
    for name, p in probabilities.items():
        place = F.lit(p) * (F.col("total") - 1)
        picks += [
            at(F.floor(place)).alias(f"{name}_lo"),
            at(F.ceil(place)).alias(f"{name}_hi"),
            F.max(place - F.floor(place)).alias(f"{name}_w"),
        ]
    return spans.agg(*picks).select(*[
        (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_w")).alias(n)
        for n in probabilities
    ])
