"""Ranks of instants: how many rows of a key lie before a bound, looked up in nested running totals.

A count between two bounds is the difference of their ranks, so a bound never meets a row. Totals are kept per block of
time; a bound adds the blocks before it, then the finer ticks inside its block, and so on. A window runs over the ticks
of one key in one block (or, at the top, over one key's blocks), never over rows, and only blocks that some bound
lies inside are opened.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """Ticks of ``size`` ms inside blocks of ``block`` ms (None: all time is one block).

    ``ticks(blocks)`` gives ``*keys, at, n``; it may leave out what lies in none of the given ``block`` starts.
    """

    size: int
    block: int | None
    ticks: Callable[[DataFrame], DataFrame]


def floored(ms: Column, size: int) -> Column:
    return ms - F.pmod(ms, F.lit(size))


def join_on(left: DataFrame, right: DataFrame, names: tuple[str, ...], how: str) -> DataFrame:
    """Null-safe equi-join that keeps the left columns and the new right ones."""
    renamed = right.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in right.columns])
    condition = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    joined = left.join(renamed, condition, how)
    return joined if how == "left_semi" else joined.drop(*[f"_{n}" for n in names])


def ranked(probes: DataFrame, keys: tuple[str, ...], levels: list[Level]) -> DataFrame:
    """``*keys, at, before`` for every distinct probe ``*keys, at``: the rows of the key before that millisecond.

    ``levels`` go from the widest ticks to the finest; the last must tell every probe apart.
    """
    asked = probes.select(*keys, "at").distinct()
    parts = [asked.withColumn("n", F.lit(0).cast("bigint"))]
    for level in levels:
        def block(ms, level=level):
            return F.lit(0).cast("bigint") if level.block is None else floored(ms, level.block)

        wanted = asked.select(*keys, "at", floored(F.col("at"), level.size).alias("upto"), block(F.col("at")).alias("block"))
        if level.block is not None:
            wanted = wanted.where("upto > block")
        places = wanted.select(*keys, "block", "upto").distinct()
        ticks = level.ticks(places.select("block").distinct()).select(*keys, block(F.col("at")).alias("block"), F.col("at").alias("upto"), "n")
        if level.block is not None:
            ticks = join_on(ticks, places.select(*keys, "block").distinct(), (*keys, "block"), "left_semi")
        # Bounds come before the tick that starts with them.
        line = ticks.withColumn("tick", F.lit(True)).unionByName(
            places.withColumn("n", F.lit(0).cast("bigint")).withColumn("tick", F.lit(False))
        )
        earlier = Window.partitionBy(*keys, "block").orderBy("upto", "tick").rowsBetween(Window.unboundedPreceding, 0)
        sums = line.withColumn("part", F.sum("n").over(earlier)).where(~F.col("tick")).select(*keys, "upto", "part")
        parts.append(join_on(wanted, sums, (*keys, "upto"), "inner").select(*keys, "at", F.col("part").alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy(*keys, "at").agg(F.sum("n").alias("before"))
