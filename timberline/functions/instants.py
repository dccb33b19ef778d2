"""Instants as epoch milliseconds: strict parsing, bucketing and wire text.

Nothing here depends on the session time zone: all arithmetic is on epoch milliseconds.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.schema import BUCKET_MS, DAY_MS

# Fixed value: the only accepted instant notation.
INSTANT_PATTERN = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})\z"

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_EPOCH_TEXT = "1970-01-01 00:00:00"


def _whole(text: Column, start: int, length: int) -> Column:
    return text.substr(F.lit(start), F.lit(length)).try_cast("bigint")


def instant_millis(text: Column) -> Column:
    """Epoch milliseconds of a strict ISO instant, NULL for anything else.

    The pattern fixes every position up to the seconds, so fields are cut by position.
    """
    day = text.substr(1, 10).try_cast("date")
    hour, minute, second = _whole(text, 12, 2), _whole(text, 15, 2), _whole(text, 18, 2)
    utc = F.endswith(text, F.lit("Z"))
    zone_chars = F.when(utc, 1).otherwise(6)
    fraction = F.when(
        text.substr(20, 1) == ".",
        text.substr(F.lit(21), F.length(text) - 20 - zone_chars),
    ).otherwise("")
    millis = F.rpad(fraction.substr(1, 3), 3, "0").try_cast("bigint")
    zone_hour = F.when(utc, 0).otherwise(F.right(text, F.lit(5)).substr(1, 2).try_cast("bigint"))
    zone_minute = F.when(utc, 0).otherwise(F.right(text, F.lit(2)).try_cast("bigint"))
    zone_sign = F.when(F.right(text, F.lit(6)).substr(1, 1) == "-", -1).otherwise(1)
    in_range = (
        day.isNotNull()
        & (hour <= 23) & (minute <= 59) & (second <= 59)
        & (zone_hour <= 23) & (zone_minute <= 59)
    )
    value = (
        F.unix_date(day).cast("bigint") * DAY_MS
        + hour * 3_600_000 + minute * 60_000 + second * 1_000 + millis
        - zone_sign * (zone_hour * 3_600_000 + zone_minute * 60_000)
    )
    return F.when(text.rlike(INSTANT_PATTERN) & in_range, value)


def millis(timestamp: Column) -> Column:
    """Epoch milliseconds, floored."""
    return F.unix_millis(timestamp)


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def bucket_millis(ms: Column, bucket: str) -> Column:
    """Epoch-aligned bucket start; ``pmod`` floors instants before 1970 as well."""
    size = BUCKET_MS[bucket]
    return ms - F.pmod(ms, F.lit(size))


def second_of(ms: Column) -> Column:
    """Epoch second, floored in integer arithmetic."""
    return F.call_function("div", ms - F.pmod(ms, F.lit(1000)), F.lit(1000))


def event_date(timestamp: Column) -> Column:
    """UTC calendar day of an instant."""
    ms = millis(timestamp)
    return F.date_from_unix_date(F.call_function("div", ms - F.pmod(ms, F.lit(DAY_MS)), F.lit(DAY_MS)).cast("int"))


def wire(ms: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` of epoch milliseconds."""
    whole = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second_of(ms))
    text = (F.lit(_EPOCH_TEXT).cast("timestamp_ntz") + whole).cast("string")
    fraction = F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0")
    return F.concat(text.substr(1, 10), F.lit("T"), text.substr(12, 8), F.lit("."), fraction, F.lit("Z"))


def wire_timestamp(timestamp: Column) -> Column:
    return wire(millis(timestamp))


def naive_millis(ntz: Column) -> Column:
    """Epoch milliseconds of a zone-less timestamp in the session zone, which ``configure`` pins to UTC."""
    return F.unix_millis(ntz.cast("timestamp"))


def to_millis(value: str | datetime | int) -> int:
    """Driver-side epoch milliseconds of one argument: a text in the notation of ``instant_millis``, a
    ``datetime`` with a zone, or the number itself."""
    if isinstance(value, int):
        return value
    if isinstance(value, str):
        if not re.match(INSTANT_PATTERN.replace(r"\z", r"\Z"), value, re.ASCII):
            raise ValueError(f"expected an ISO 8601 instant: {value!r}")
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        raise ValueError("a datetime needs a time zone")
    return (value - _EPOCH) // timedelta(milliseconds=1)


def to_wire(value: str | datetime | int) -> str:
    """Driver-side wire text of one argument."""
    ms = to_millis(value)
    moment = _EPOCH + timedelta(milliseconds=ms)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def to_date(value: str | datetime | int):
    return (_EPOCH + timedelta(milliseconds=to_millis(value))).date()


def instant_lit(value: str | datetime | int) -> Column:
    """Literal instant; folds to a constant, so comparisons with it reach the Parquet scan."""
    return F.timestamp_millis(F.lit(to_millis(value)).cast("bigint"))
