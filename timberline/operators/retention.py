"""What a retention pass removes, as frames; ``LogTable.apply_retention`` applies it to storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators.filters import Instant
from timberline.operators.numbering import numbered
from timberline.schema import DAY_MS, RETENTION_BATCH


def cutoff(now: Instant, days: float) -> int:
    """First millisecond kept; ``days`` may be a fraction."""
    if not days > 0:
        raise ValueError("retention days must be positive")
    return int(instants.to_millis(now) - days * DAY_MS)


def expired(logs: DataFrame, cutoff_at: Instant) -> DataFrame:
    """Rows strictly before the cutoff."""
    return logs.where(F.col("timestamp") < instants.instant_lit(cutoff_at))


def survivors(logs: DataFrame, cutoff_at: Instant) -> DataFrame:
    return logs.where(F.col("timestamp") >= instants.instant_lit(cutoff_at))


def retention_plan(
    logs: DataFrame, cutoff_at: Instant, batch: int = RETENTION_BATCH, partitions: int | None = None
) -> DataFrame:
    """Oldest-first batches of expired rows: ``batch_no`` from 1, ``rows`` and the last key of each."""
    keys = expired(logs, cutoff_at).select("timestamp", "id")
    rows = numbered(keys, [F.asc("timestamp"), F.asc("id")], "retention", partitions)
    in_batch = F.pmod(F.col("row_no"), F.lit(batch))
    last = (in_batch == batch - 1) | (F.col("row_no") == F.col("row_total") - 1)
    return rows.where(last).select(
        (F.floor(F.col("row_no") / batch) + 1).cast("bigint").alias("batch_no"),
        (in_batch + 1).cast("bigint").alias("rows"),
        F.col("timestamp").alias("last_ts"),
        F.col("id").alias("last_id"),
    )


def delete_matching(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the table whose ``(timestamp, id)`` is not in the key set."""
    return _by_key(logs, keys, "left_anti")


def matching(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the table whose ``(timestamp, id)`` is in the key set."""
    return _by_key(logs, keys, "left_semi")


def _by_key(logs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    on, wanted = ["timestamp", "id"], keys.select("timestamp", "id")
    if "event_date" in logs.columns:
        # The date follows from the instant; as a join key it lets Spark skip the other partitions.
        on, wanted = [*on, "event_date"], wanted.withColumn("event_date", instants.event_date(F.col("timestamp")))
    return logs.join(wanted, on, how).select(*logs.columns)
