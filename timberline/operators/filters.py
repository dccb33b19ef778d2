"""Predicates over the log table, as a conjunction of what is supplied."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.schema import (
    BUCKET_MS,
    DEFAULT_PAGE_LIMIT,
    GROUPS,
    LEVELS,
    MAX_ATTRIBUTE_KEY_CHARS,
    MAX_PAGE_LIMIT,
)

Instant = str | datetime | int


@dataclass(frozen=True)
class LogFilter:
    """``None`` means not supplied; an empty string is a real value."""

    service: str | None = None
    level: str | None = None
    since: Instant | None = None
    until: Instant | None = None
    q: str | None = None
    attributes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.level is not None and self.level not in LEVELS:
            raise ValueError("invalid level")
        if self.since is not None and self.until is not None:
            if instants.to_millis(self.until) < instants.to_millis(self.since):
                raise ValueError("until must not be before since")
        for key in self.attributes:
            if not 1 <= len(key) <= MAX_ATTRIBUTE_KEY_CHARS:
                raise ValueError("invalid attribute key")

    def between(self, since: Instant, until: Instant) -> LogFilter:
        return replace(self, since=since, until=until)

    @property
    def countable(self) -> bool:
        """Whether per-second counts by service and level can answer it."""
        return self.q is None and not self.attributes


def service_eq(value: str) -> Column:
    return F.col("service") == F.lit(value)


def level_eq(value: str) -> Column:
    return F.col("level") == F.lit(value)


def since(value: Instant) -> Column:
    return F.col("timestamp") >= instants.instant_lit(value)


def until(value: Instant) -> Column:
    return F.col("timestamp") < instants.instant_lit(value)


def attr_eq(key: str, value: str) -> Column:
    """Text equality; a missing key never matches."""
    return F.try_element_at("attr", F.lit(key)) == F.lit(value)


def message_contains(q: str) -> Column:
    """Case-insensitive literal substring: no character is a wildcard."""
    return F.contains(F.lower("message"), F.lower(F.lit(q)))


def before_cursor(timestamp: Instant, id: str) -> Column:
    """``(timestamp, id)`` strictly before the given key, written so that the scan can use it."""
    at = instants.instant_lit(timestamp)
    return (F.col("timestamp") <= at) & ((F.col("timestamp") < at) | (F.col("id") < F.lit(id.lower())))


def range_union(ranges: Iterable[tuple[Instant, Instant]]) -> Column:
    """Any of several half-open ranges."""
    return reduce(lambda a, b: a | b, [since(lo) & until(hi) for lo, hi in ranges])


def date_bounds(lo: Instant | None, hi: Instant | None) -> list[Column]:
    """Partition predicates that follow from a half-open range."""
    bounds = []
    if lo is not None:
        bounds.append(F.col("event_date") >= F.lit(instants.to_date(lo)))
    if hi is not None:
        bounds.append(F.col("event_date") <= F.lit(instants.to_date(hi)))
    return bounds


def predicates(f: LogFilter, columns: Iterable[str]) -> list[Column]:
    columns = set(columns)
    found: list[Column] = []
    if f.service is not None:
        found.append(service_eq(f.service))
    if f.level is not None:
        found.append(level_eq(f.level))
    if f.since is not None:
        found.append(since(f.since))
    if f.until is not None:
        found.append(until(f.until))
    if "event_date" in columns:
        found.extend(date_bounds(f.since, f.until))
    for key, value in f.attributes.items():
        if key == "marker" and "attr_marker" in columns:
            found.append(F.col("attr_marker") == F.lit(value))
        else:
            found.append(attr_eq(key, value))
    if f.q is not None:
        found.append(message_contains(f.q))
    return found


def apply_filters(logs: DataFrame, f: LogFilter) -> DataFrame:
    for predicate in predicates(f, logs.columns):
        logs = logs.where(predicate)
    return logs


def audit_filters(filters: DataFrame) -> DataFrame:
    """Judge a table of saved filters given as text.

    Input columns (all STRING): ``filter_id, service, level, since, until, q, attr_k, attr_v, limit,
    bucket, group_by``. Adds ``reason`` (NULL when valid), ``since_ms``, ``until_ms`` and
    ``page_limit``. A row with a bucket or grouping is a counting request, which needs both bounds and
    takes no limit.
    """
    staged = filters.select(
        "*",
        instants.instant_millis(F.col("since")).alias("since_ms"),
        instants.instant_millis(F.col("until")).alias("until_ms"),
        F.when(F.col("limit").rlike(r"\A[0-9]+\z"), F.coalesce(
            F.col("limit").try_cast("bigint"), F.lit(MAX_PAGE_LIMIT + 1)
        )).alias("_limit"),
    )
    counting = F.col("bucket").isNotNull() | F.col("group_by").isNotNull()
    reason = (
        F.when(counting & F.col("limit").isNotNull(), "cursor and limit are not supported for aggregation")
        .when(F.col("level").isNotNull() & ~F.col("level").isin(*LEVELS), "invalid level")
        .when(F.col("since").isNotNull() & F.col("since_ms").isNull(), "since must be a valid ISO 8601 instant")
        .when(F.col("until").isNotNull() & F.col("until_ms").isNull(), "until must be a valid ISO 8601 instant")
        .when(F.col("until_ms") < F.col("since_ms"), "until must not be before since")
        .when(
            F.col("attr_k").isNotNull() & ~F.length("attr_k").between(1, MAX_ATTRIBUTE_KEY_CHARS),
            "invalid attribute key",
        )
        .when(counting & (F.col("since").isNull() | F.col("until").isNull()), "since and until are required")
        .when(
            counting & ~F.coalesce(F.col("bucket").isin(*BUCKET_MS), F.lit(False)),
            "bucket must be one of: 1m, 5m, 1h, 1d",
        )
        .when(F.col("group_by").isNotNull() & ~F.col("group_by").isin(*GROUPS), "group_by must be service or level")
        .when(F.col("limit").isNotNull() & F.col("_limit").isNull(), "limit must be an integer")
        .when(~F.col("_limit").between(1, MAX_PAGE_LIMIT), "limit must be between 1 and 1000")
    )
    return staged.withColumn("reason", reason).select(
        *filters.columns,
        "reason",
        F.when(F.col("reason").isNull(), F.col("since_ms")).alias("since_ms"),
        F.when(F.col("reason").isNull(), F.col("until_ms")).alias("until_ms"),
        F.when(
            F.col("reason").isNull() & ~counting, F.coalesce("_limit", F.lit(DEFAULT_PAGE_LIMIT)).cast("int")
        ).alias("page_limit"),
    )
