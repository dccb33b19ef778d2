"""Counts in nested time cells, and ranges cut into the fewest of them.

A cell counts the rows of one service and level in one second, minute, hour or day. Every coarser cell is made of whole
finer ones, so a range has one shortest cover: the widest cells that fit inside, then finer ones towards both edges,
and rows where no cell fits. A month by the hour reads hours, at most 118 minutes and 118 seconds, and rows of two
seconds. Cells of several commits add up; a late row adds to the cell of its instant in every tier.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators import filters as P
from timberline.operators.aggregate import check_bucket, count_by_bucket, group_column, present
from timberline.schema import BUCKET_MS, RECENT_WINDOW_MS

# Seconds of a cell, finest first, and the calendar unit whose cells are stored together.
TIERS = {1: "day", 60: "month", 3_600: "month", 86_400: "year"}
# How long the cells of a tier are kept by default, in milliseconds; the coarsest for good.
KEPT_MS = {1: RECENT_WINDOW_MS, 60: 2 * 86_400_000, 3_600: 92 * 86_400_000, 86_400: None}


def cells_of(logs: DataFrame, tiers=tuple(TIERS)) -> DataFrame:
    """``tier, start, service, level, n``: one cell per non-zero count; ``start`` in epoch seconds."""
    second = instants.second_of(instants.millis(F.col("timestamp")))
    starts = F.array(*[
        F.struct(F.lit(t).alias("tier"), (F.col("second") - F.pmod("second", F.lit(t))).alias("start")) for t in tiers
    ])
    keyed = logs.select(second.alias("second"), "service", "level").select(F.explode(starts).alias("c"), "service", "level")
    return keyed.groupBy("c.tier", "c.start", "service", "level").agg(F.count(F.lit(1)).alias("n"))


def period_of(tier: Column, start: Column) -> Column:
    """First date of the unit that a cell is stored with."""
    day = F.date_from_unix_date(F.call_function("div", start - F.pmod(start, F.lit(86_400)), F.lit(86_400)).cast("int"))
    choice = day
    for seconds, unit in TIERS.items():
        if unit != "day":
            choice = F.when(tier == seconds, F.trunc(day, unit)).otherwise(choice)
    return choice


def period_date(tier: int, ms: int):
    """``period_of`` on the driver."""
    day = instants.to_date(ms)
    return {"day": day, "month": day.replace(day=1), "year": day.replace(month=1, day=1)}[TIERS[tier]]


@dataclass(frozen=True)
class Cover:
    """Disjoint half-open ranges in milliseconds: ``pieces`` (tier, from, to) of whole cells, ``rows`` of the rest."""

    pieces: tuple[tuple[int, int, int], ...]
    rows: tuple[tuple[int, int], ...]


def complete(covered_from: P.Instant) -> dict[int, int]:
    """Every tier covers all from an instant on."""
    return {tier: instants.to_millis(covered_from) for tier in TIERS}


def coverage(now: P.Instant, kept_ms: dict = KEPT_MS) -> dict[int, int | None]:
    """First covered millisecond of each tier after eviction; None: everything."""
    at = instants.to_millis(now)
    return {t: None if ms is None else (at - ms) // (t * 1000) * (t * 1000) for t, ms in kept_ms.items()}


def evict_tiers(cells: DataFrame, now: P.Instant, kept_ms: dict = KEPT_MS) -> DataFrame:
    """Cells that are still kept."""
    kept = F.lit(False)
    for tier, first in coverage(now, kept_ms).items():
        mine = F.col("tier") == tier
        kept = kept | (mine if first is None else mine & (F.col("start") >= first // 1000))
    return cells.where(kept)


def cover(since: P.Instant, until: P.Instant, widest_ms: int, covered: dict[int, int | None]) -> Cover:
    """The fewest cells of at most ``widest_ms`` that fill a range, and what is left for the rows.

    ``covered``: first covered millisecond of each tier in use, None where it covers everything.
    """
    pieces: list[tuple[int, int, int]] = []
    rows: list[tuple[int, int]] = []

    def cut(lo: int, hi: int, tiers: list[int]) -> None:
        if lo >= hi:
            return
        if not tiers:
            rows.append((lo, hi))
            return
        size = tiers[0] * 1000
        first = lo if covered[tiers[0]] is None else max(lo, covered[tiers[0]])
        a, b = -(-first // size) * size, hi // size * size
        if a >= b:
            cut(lo, hi, tiers[1:])
            return
        cut(lo, a, tiers[1:])
        pieces.append((tiers[0], a, b))
        cut(b, hi, tiers[1:])

    usable = sorted((t for t in covered if widest_ms % (t * 1000) == 0), reverse=True)
    cut(instants.to_millis(since), instants.to_millis(until), usable)
    merged: list[tuple[int, int]] = []
    for lo, hi in rows:
        if merged and merged[-1][1] == lo:
            merged[-1] = (merged[-1][0], hi)
        else:
            merged.append((lo, hi))
    return Cover(tuple(pieces), tuple(merged))


def within(pieces, columns) -> Column:
    """The cells of a cover; one condition for all tiers, so that the table is read once."""
    found = []
    for tier, lo, hi in pieces:
        part = (F.col("tier") == tier) & (F.col("start") >= lo // 1000) & (F.col("start") < hi // 1000)
        if "period" in columns:
            part = part & F.col("period").between(F.lit(period_date(tier, lo)), F.lit(period_date(tier, hi - 1)))
        found.append(part)
    return reduce(lambda a, b: a | b, found, F.lit(False))


def _cells_in(cells: DataFrame, f: P.LogFilter, c: Cover, bucket: str, groups: list[Column]) -> DataFrame:
    """``start_ms``, the groups and ``n`` of the cells of a cover."""
    found = cells.where(within(c.pieces, cells.columns))
    if f.service is not None:
        found = found.where(P.service_eq(f.service))
    if f.level is not None:
        found = found.where(P.level_eq(f.level))
    return found.select(instants.bucket_millis(F.col("start") * 1000, bucket).alias("start_ms"), *groups, "n")


def rows_of(logs: DataFrame, f: P.LogFilter, c: Cover) -> DataFrame:
    """The rows that the cells leave out."""
    found = logs.where(P.range_union(c.rows))
    if "event_date" in logs.columns:
        days = [P.date_bounds(lo, hi - 1) for lo, hi in c.rows]
        found = found.where(reduce(lambda a, b: a | b, [first & last for first, last in days]))
    return P.apply_filters(found, P.LogFilter(service=f.service, level=f.level))


def _counted(logs: DataFrame, cells: DataFrame, f: P.LogFilter, c: Cover, bucket: str, groups: list[Column]) -> DataFrame:
    """Cells, and rows as cells of one, summed in one shuffle: ``start_ms``, the groups and ``count``."""
    check_bucket(bucket)
    start = instants.bucket_millis(instants.millis(F.col("timestamp")), bucket)
    rows = rows_of(logs, f, c) if c.rows else logs.limit(0)
    parts = [rows.select(start.alias("start_ms"), *groups, F.lit(1).cast("bigint").alias("n"))] if c.rows or not c.pieces else []
    if c.pieces:
        parts.append(_cells_in(cells, f, c, bucket, groups))
    names = [name for name in parts[0].columns if name != "n"]
    return reduce(DataFrame.unionByName, parts).groupBy(*names).agg(F.sum("n").alias("count"))


def count_with_tiers(logs: DataFrame, cells: DataFrame, f: P.LogFilter, c: Cover, bucket: str, group_by: str | None) -> DataFrame:
    """``start_ms, group, count`` from the cells of a cover and the rows it leaves out."""
    # Grouping by a NULL literal as well would only widen the key.
    if group_by is None:
        return _counted(logs, cells, f, c, bucket, []).select("start_ms", group_column(None).alias("group"), "count")
    return _counted(logs, cells, f, c, bucket, [group_column(group_by).alias("group")])


def aggregate_with_tiers(
    logs: DataFrame, cells: DataFrame, f: P.LogFilter, bucket: str, group_by: str | None = None,
    covered: dict[int, int | None] | None = None, ordered: bool = True,
) -> DataFrame:
    """``count_by_bucket`` from the fewest cells; requests that cells cannot answer read the rows.

    ``covered`` as in ``cover``; without it the cells are taken to be complete.
    """
    if f.since is None or f.until is None:
        raise ValueError("since and until are required")
    check_bucket(bucket)
    if not f.countable:
        return count_by_bucket(logs, f, bucket, group_by, ordered)
    c = cover(f.since, f.until, BUCKET_MS[bucket], covered or dict.fromkeys(TIERS))
    return present(count_with_tiers(logs, cells, f, c, bucket, group_by), ordered)


def count_by_key(logs: DataFrame, cells: DataFrame, f: P.LogFilter, c: Cover, bucket: str) -> DataFrame:
    """``start_ms, service, level, count``: what all panels of a board are derived from."""
    return _counted(logs, cells, f, c, bucket, [F.col("service"), F.col("level")])
