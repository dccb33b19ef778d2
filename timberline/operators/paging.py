"""Newest-first pages with stable keyset boundaries, one at a time or all at once."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.functions.ids import UUID_PATTERN
from timberline.operators import filters as P
from timberline.operators.numbering import numbered
from timberline.schema import DEFAULT_PAGE_LIMIT, MAX_PAGE_LIMIT
from timberline.session import broadcast_if_small

# Boundary notation version and what the fingerprint covers.
BOUNDARY_VERSION = 1
ENDPOINT = "logs"

# Saved filters are small rows; this many of them stay far below Spark's broadcast limit.
MAX_BROADCAST_FILTERS = 100_000


def newest(logs: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest rows: a heap per task, merged; the table is never sorted."""
    return logs.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def _look_ahead(logs, f, limit, cursor) -> DataFrame:
    if not 1 <= limit <= MAX_PAGE_LIMIT:
        raise ValueError("limit must be between 1 and 1000")
    found = P.apply_filters(logs, f)
    if cursor is not None:
        found = found.where(P.before_cursor(*cursor))
        if "event_date" in found.columns:
            found = found.where(F.col("event_date") <= F.lit(instants.to_date(cursor[0])))
    return newest(found, limit + 1)


def page_rows(
    logs: DataFrame,
    f: P.LogFilter,
    limit: int = DEFAULT_PAGE_LIMIT,
    cursor: Boundary | tuple[P.Instant, str] | None = None,
) -> DataFrame:
    """One page as a frame, with ``row_no`` from 1 and ``has_more``.

    The windows run over the look-ahead result, at most ``limit + 1`` rows.
    """
    order = Window.orderBy(F.desc("timestamp"), F.desc("id"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        _look_ahead(logs, f, limit, checked_key(logs.sparkSession, f, cursor))
        .withColumn("row_no", F.row_number().over(order))
        .withColumn("has_more", F.count(F.lit(1)).over(whole) > limit)
        .where(F.col("row_no") <= limit)
    )


class Boundary(NamedTuple):
    """The key a page ended at, bound to the filter it was read with."""

    ts: int
    id: str
    v: int
    fingerprint: str


@dataclass(frozen=True)
class Page:
    """At most ``limit`` rows; ``boundary`` is what to continue from, None on the last page."""

    rows: list[Row]
    boundary: Boundary | None


def fingerprint_of(spark: SparkSession, f: P.LogFilter) -> str:
    """``filter_fingerprint`` of one filter, folded without a job."""
    def text(value: str | None) -> Column:
        return F.lit(value).cast("string")

    def at(value: P.Instant | None) -> Column:
        return text(None if value is None else instants.to_wire(value))

    attr = F.create_map(*[F.lit(x) for pair in f.attributes.items() for x in pair]).cast("map<string,string>")
    found = filter_fingerprint(text(f.service), text(f.level), at(f.since), at(f.until), text(f.q), attr)
    return spark.createDataFrame([(1,)], "x int").select(found).first()[0]


def checked_key(spark: SparkSession, f: P.LogFilter, cursor: Boundary | tuple[P.Instant, str] | None):
    """The key of a boundary, if it belongs to the filter; a bare key is taken as it is."""
    if isinstance(cursor, Boundary):
        if cursor.v != BOUNDARY_VERSION or not re.search(UUID_PATTERN.replace(r"\z", r"\Z"), cursor.id) \
                or cursor.fingerprint != fingerprint_of(spark, f):
            raise ValueError("invalid cursor")
        return cursor.ts, cursor.id
    return cursor


def page(
    logs: DataFrame,
    f: P.LogFilter,
    limit: int = DEFAULT_PAGE_LIMIT,
    cursor: Boundary | tuple[P.Instant, str] | None = None,
) -> Page:
    """One page on the driver, which holds no more than ``limit + 1`` rows."""
    return read_page(logs, f, f, limit, checked_key(logs.sparkSession, f, cursor))


def read_page(logs: DataFrame, f: P.LogFilter, asked: P.LogFilter, limit: int, key) -> Page:
    """A page of the rows that pass ``f``, continued under the filter that was asked for."""
    rows = _look_ahead(logs, f, limit, key).withColumn("timestamp_ms", instants.millis(F.col("timestamp"))).collect()
    kept = rows[:limit]
    if len(rows) <= limit:
        return Page(kept, None)
    last = kept[-1]
    return Page(kept, Boundary(last["timestamp_ms"], last["id"], BOUNDARY_VERSION, fingerprint_of(logs.sparkSession, asked)))


def page_table(logs: DataFrame, limit: int = DEFAULT_PAGE_LIMIT, partitions: int | None = None) -> DataFrame:
    """Every page of a result: ``page_no`` from 1, ``rows`` and the key of its last row.

    Only keys are shuffled, once; the last row of a page is found by its number, without grouping.
    """
    keys = logs.select("timestamp", "id")
    rows = numbered(keys, [F.desc("timestamp"), F.desc("id")], "pages", partitions)
    in_page = F.pmod(F.col("row_no"), F.lit(limit))
    last = (in_page == limit - 1) | (F.col("row_no") == F.col("row_total") - 1)
    return rows.where(last).select(
        (F.floor(F.col("row_no") / limit) + 1).cast("bigint").alias("page_no"),
        (in_page + 1).cast("bigint").alias("rows"),
        F.col("timestamp").alias("boundary_ts"),
        F.col("id").alias("boundary_id"),
        (F.col("row_no") < F.col("row_total") - 1).alias("has_more"),
    )


def merge_pages(held: DataFrame, older: DataFrame) -> DataFrame:
    """Append ``older``, dropping rows whose id is already held or repeated within it."""
    fresh = older.join(held.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return held.unionByName(fresh.select(*held.columns))


def filter_fingerprint(
    service: Column, level: Column, since: Column, until: Column, q: Column, attr: Column
) -> Column:
    """SHA-256 of a filter's canonical JSON; instants as wire text, attribute keys sorted, no limit."""
    sorted_attr = F.map_from_entries(F.array_sort(F.map_entries(attr)))
    canonical = F.struct(
        F.lit(ENDPOINT).alias("endpoint"), service.alias("service"), level.alias("level"),
        since.alias("since"), until.alias("until"), q.alias("q"),
        F.coalesce(sorted_attr, F.create_map().cast("map<string,string>")).alias("attributes"),
    )
    return F.sha2(F.to_json(canonical, {"ignoreNullFields": "false"}), 256)


def check_boundaries(boundaries: DataFrame, filters: DataFrame) -> DataFrame:
    """Judge saved page boundaries against the filters they are to be used with.

    ``boundaries``: ``boundary_id, filter_id, v, ts, id, fingerprint``; ``filters``: ``filter_id,
    current_fingerprint``. Adds ``reason``, NULL when the boundary may be used.
    """
    usable = (
        (F.col("v") == BOUNDARY_VERSION)
        & instants.instant_millis(F.col("ts")).isNotNull()
        & F.col("id").rlike(UUID_PATTERN)
        & F.col("fingerprint").rlike(r"\A[0-9a-f]{64}\z")
        & (F.col("fingerprint") == F.col("current_fingerprint"))
    )
    small = broadcast_if_small(filters.select("filter_id", "current_fingerprint"), MAX_BROADCAST_FILTERS)
    return boundaries.join(small, "filter_id", "left").select(
        "boundary_id", "filter_id",
        F.when(~F.coalesce(usable, F.lit(False)), "invalid cursor").alias("reason"),
    )
