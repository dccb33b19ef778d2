"""Table schemas and fixed values of the log model."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, limits and sizes that results depend on.
LEVELS = ("debug", "info", "warn", "error")
ENTRY_FIELDS = ("timestamp", "level", "service", "message", "attributes")
REQUIRED_FIELDS = ("timestamp", "level", "service", "message")
BUCKET_MS = {"1m": 60_000, "5m": 300_000, "1h": 3_600_000, "1d": 86_400_000}
GROUPS = ("service", "level")
MAX_SERVICE_CHARS = 256
MAX_MESSAGE_CHARS = 16_384
MAX_ATTRIBUTE_KEY_CHARS = 256
MAX_ATTRIBUTES_BYTES = 65_536
MAX_LOGS_PER_BATCH = 2_000
FUTURE_TOLERANCE_MS = 300_000
DEFAULT_PAGE_LIMIT = 100
MAX_PAGE_LIMIT = 1_000
RECENT_WINDOW_MS = 7_200_000
MAX_SAFE_COUNT = 9_007_199_254_740_991
VISIBILITY_DEADLINE_MS = 20_000
RETENTION_BATCH = 2_000
DAY_MS = 86_400_000
RANGE_PRESET_MS = {
    "15m": 900_000,
    "1h": 3_600_000,
    "6h": 21_600_000,
    "24h": 86_400_000,
    "7d": 604_800_000,
    "30d": 2_592_000_000,
}
TOP_SERVICES = 5
OTHER = "Other"

# One JSON document per row.
ENVELOPES = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("body", T.StringType()),
])

# What readers see.
LOG_COLUMNS = ("id", "timestamp", "level", "service", "message", "attributes", "attr")

# What is stored; ``attr_marker`` is the promoted hot attribute.
STORED_LOGS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("level", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("attributes", T.StringType()),
    T.StructField("attr", T.MapType(T.StringType(), T.StringType())),
    T.StructField("attr_marker", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("commit_id", T.LongType()),
])

STORED_REJECTS = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("idx", T.IntegerType()),
    T.StructField("reason", T.StringType()),
    T.StructField("commit_id", T.LongType()),
])

# Cells of every tier: ``start`` in epoch seconds, ``tier`` the seconds of a cell, ``period`` the first date of its folder.
STORED_ROLLUP = T.StructType([
    T.StructField("start", T.LongType()),
    T.StructField("service", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("tier", T.IntegerType()),
    T.StructField("period", T.DateType()),
    T.StructField("commit_id", T.LongType()),
])

# One row per committed write: the commit marker and the ingest totals in one.
STORED_COMMITS = T.StructType([
    T.StructField("batches", T.LongType()),
    T.StructField("failed_batches", T.LongType()),
    T.StructField("accepted", T.LongType()),
    T.StructField("rejected", T.LongType()),
    T.StructField("normalized_bytes", T.LongType()),
    T.StructField("committed_at", T.TimestampType()),
    T.StructField("commit_id", T.LongType()),
])

# One row per retention pass, written when its folders are gone.
STORED_RETENTION = T.StructType([
    T.StructField("cutoff", T.TimestampType()),
    T.StructField("rows_deleted", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
])

RAW_RESOURCE_SAMPLES = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("container", T.StringType()),
    T.StructField("cpu_percent", T.StringType()),
    T.StructField("memory_usage", T.StringType()),
    T.StructField("memory_percent", T.StringType()),
])
