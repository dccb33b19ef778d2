"""The whole report board on one clock."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators import reporting, tiers
from timberline.operators.filters import Instant, LogFilter, apply_filters
from timberline.operators.paging import Boundary, Page, newest, page
from timberline.schema import BUCKET_MS, DEFAULT_PAGE_LIMIT, RANGE_PRESET_MS, STORED_LOGS
from timberline.sources.log_table import LogTable
from timberline.sources.wire import to_wire


@dataclass(frozen=True)
class Report:
    """``series``: ``start, series, series_no, value, offset``; ``metrics``: one row; ``latest``: rows.

    ``page`` reads the rows in pages: the first without a boundary, then from the boundary of the page before. The range
    was resolved once, so all pages and panels keep the board's clock, whatever arrives after it.
    """

    filter: LogFilter
    bucket: str
    series: DataFrame
    metrics: DataFrame
    latest: DataFrame
    page: Callable[..., Page]


def trimmed(f: LogFilter) -> LogFilter:
    """Report inputs are trimmed and blank ones dropped, unlike those of the plain operators."""
    def text(value: str | None) -> str | None:
        return (value or "").strip() or None

    return LogFilter(
        text(f.service), text(f.level), f.since, f.until, text(f.q),
        {k.strip(): v for k, v in f.attributes.items() if k.strip()},
    )


def resolve_range(now: Instant, preset: str | None, since: Instant | None, until: Instant | None):
    if preset is not None and preset != "custom":
        hi = instants.to_millis(now)
        lo = hi - RANGE_PRESET_MS[preset]
    else:
        if since is None or until is None:
            raise ValueError(reporting.BAD_RANGE)
        lo, hi = instants.to_millis(since), instants.to_millis(until)
    if hi <= lo:
        raise ValueError(reporting.EMPTY_RANGE)
    bucket = next((b for b, limit in reporting.BUCKET_UP_TO_MS if hi - lo <= limit), reporting.WIDEST_BUCKET)
    return lo, hi, bucket


def _panels(counted: DataFrame, group_by: str) -> tuple[DataFrame, DataFrame]:
    """Series and metrics from ``start_ms, service, level, count``."""
    cells = counted.withColumn("start", instants.wire(F.col("start_ms")))
    by_level = cells.groupBy("start", F.col("level").alias("group")).agg(F.sum("count").alias("count"))
    by_service = cells.groupBy("start", F.col("service").alias("group")).agg(F.sum("count").alias("count"))
    rows = reporting.level_rows(by_level) if group_by == "level" else reporting.service_series(by_service)
    per_start = by_level.groupBy("start").agg(
        F.sum("count").alias("n"), F.sum(F.when(F.col("group") == "error", F.col("count")).otherwise(0)).alias("e")
    )
    metrics = per_start.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.max("n"), F.lit(0)).alias("peak"),
        F.try_divide(F.sum("e").cast("double"), F.sum("n").cast("double")).alias("error_share"),
    )
    return reporting.stack_offsets(rows), metrics


def dashboard_report(
    logs: DataFrame,
    f: LogFilter,
    now: Instant,
    preset: str | None = "1h",
    group_by: str = "level",
    limit: int = DEFAULT_PAGE_LIMIT,
    cells: DataFrame | None = None,
    covered: dict[int, int | None] | None = None,
) -> Report:
    """All panels from one filtered input and one counting pass by bucket, service and level.

    With ``cells`` (the tiers of ``cells_of``) a board without text or attribute filter counts from them.
    """
    f = trimmed(f)
    lo, hi, bucket = resolve_range(now, preset, f.since, f.until)
    f = f.between(lo, hi)
    found = apply_filters(logs, f)
    if cells is not None and f.countable:
        c = tiers.cover(lo, hi, BUCKET_MS[bucket], covered or dict.fromkeys(tiers.TIERS))
        counted = tiers.count_by_key(logs, cells, f, c, bucket)
    else:
        start = instants.bucket_millis(instants.millis(F.col("timestamp")), bucket)
        counted = found.groupBy(start.alias("start_ms"), "service", "level").agg(F.count(F.lit(1)).alias("count"))
    series, metrics = _panels(counted, group_by)

    def pages(cursor: Boundary | None = None) -> Page:
        return page(logs, f, limit, cursor)

    return Report(f, bucket, series, metrics, to_wire(newest(found, limit)), pages)


def table_report(
    table: LogTable, f: LogFilter, now: Instant, preset: str | None = "1h", group_by: str = "level",
    limit: int = DEFAULT_PAGE_LIMIT,
) -> Report:
    """The board of a stored table: counts from its cells, rows from its newest dates back."""
    f = trimmed(f)
    lo, hi, bucket = resolve_range(now, preset, f.since, f.until)
    f = f.between(lo, hi)
    if not f.countable:
        return dashboard_report(table.read_logs(f), f, now, "custom", group_by, limit)
    series, metrics = _panels(table.count_by_key(f, bucket), group_by)

    def pages(cursor: Boundary | None = None) -> Page:
        return table.newest_page(f, limit, cursor)

    rows = [tuple(row[name] for name in STORED_LOGS.names) for row in pages().rows]  # at most ``limit``
    latest = table.spark.createDataFrame(rows, STORED_LOGS).orderBy(F.desc("timestamp"), F.desc("id"))
    return Report(f, bucket, series, metrics, to_wire(latest), pages)


def as_rows(report: Report) -> DataFrame:
    """The board as one long frame: ``panel, start, series, value``."""
    series = report.series.select(
        F.lit("series").alias("panel"), "start", "series", F.col("value").cast("double").alias("value")
    )
    metrics = report.metrics.select(
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("series"), F.col(n).cast("double").alias("value"))
            for n in ("total", "peak", "error_share")
        ])).alias("m")
    ).select(F.lit("metric").alias("panel"), F.lit(None).cast("string").alias("start"), "m.*")
    latest = report.latest.select(
        F.lit("latest").alias("panel"), F.col("timestamp").alias("start"), F.col("id").alias("series"),
        F.lit(None).cast("double").alias("value"),
    )
    return series.unionByName(metrics).unionByName(latest)
