"""The star-schema test tables presented as log tables, envelopes and saved requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators.filters import Instant
from timberline.session import configure

ID_PREFIX = "00000000-0000-7000-8000-"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def hex_id(number: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), F.lpad(F.lower(F.hex(number)), 12, "0"))


def _raw_bounds(raw: DataFrame, column: str, since: Instant | None, until: Instant | None) -> DataFrame:
    """Bounds on the stored column itself. They are whole milliseconds, so they select the same rows as
    bounds on the millisecond column derived from it, but reach the Parquet scan."""
    if since is not None:
        raw = raw.where(F.col(column) >= F.lit(_naive(since)).cast("timestamp_ntz"))
    if until is not None:
        raw = raw.where(F.col(column) < F.lit(_naive(until)).cast("timestamp_ntz"))
    return raw


def _naive(value: Instant) -> str:
    return instants.to_wire(value).replace("T", " ").rstrip("Z")


LEVEL_OF_TYPE = {"error": "error", "purchase": "warn", "signup": "info", "click": "info", "view": "debug"}


def level_of(event_type: Column) -> Column:
    level = F.lit(None).cast("string")
    for kind, name in LEVEL_OF_TYPE.items():
        level = F.when(event_type == kind, name).otherwise(level)
    return level


def service_of(user_id: Column) -> Column:
    return F.concat(F.lit("svc-"), F.pmod(user_id, F.lit(8)).cast("string"))


def message_of(event_type: Column, user_id: Column) -> Column:
    return F.concat(event_type, F.lit(" by user_"), user_id.cast("string"), F.lit(" 100% done"))


def logs_from(events: DataFrame, *extra: str) -> DataFrame:
    """``events`` rows as log rows; ``extra`` names event columns to keep besides."""
    return events.select(
        hex_id(F.col("event_id")).alias("id"),
        instants.from_millis(instants.naive_millis(F.col("ts"))).alias("timestamp"),
        level_of(F.col("event_type")).alias("level"),
        service_of(F.col("user_id")).alias("service"),
        message_of(F.col("event_type"), F.col("user_id")).alias("message"),
        F.col("props").alias("attributes"),
        F.from_json("props", "map<string,string>").alias("attr"),
        *extra,
    )


def logs_view(
    spark: SparkSession, sf_dir: str, since: Instant | None = None, until: Instant | None = None
) -> DataFrame:
    """``events`` as the log table."""
    return logs_from(_raw_bounds(table(spark, sf_dir, "events"), "ts", since, until))


def documents_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as logs with long messages; they carry no instant."""
    return table(spark, sf_dir, "documents").select(
        hex_id(F.col("doc_id")).alias("id"),
        F.col("source").alias("service"),
        F.col("text").alias("message"),
    )


def orders_view(
    spark: SparkSession, sf_dir: str, since: Instant | None = None, until: Instant | None = None
) -> DataFrame:
    """``orders`` as a sparse log table over several years."""
    raw = _raw_bounds(table(spark, sf_dir, "orders"), "o_orderdate", since, until)
    return raw.select(
        hex_id(F.col("o_orderkey")).alias("id"),
        instants.from_millis(instants.naive_millis(F.col("o_orderdate"))).alias("timestamp"),
        F.lit("info").alias("level"),
        F.col("o_orderpriority").alias("service"),
        F.col("o_orderstatus").alias("message"),
        F.lit("{}").alias("attributes"),
        F.create_map().cast("map<string,string>").alias("attr"),
    )


# Fixed value: the clock of the derived batches, after every event.
BATCH_CLOCK = "2024-02-01T00:00:00.000Z"
BATCH_SIZE = 5
DEFECTS = 20


def envelopes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` packed five to a batch, with a defect chosen by the event number.

    0 unknown level, 1 no service, 2 extra field, 3 wrong instant notation, 4 nested attribute,
    5 empty message, 6 instant far ahead, otherwise valid.
    """
    logs = logs_from(table(spark, sf_dir, "events"), "event_id", "value")
    defect = F.pmod("event_id", F.lit(DEFECTS))

    at = instants.wire_timestamp(F.col("timestamp"))
    instant = (
        F.when(defect == 3, F.replace(at, F.lit("T"), F.lit(" ")))
        .when(defect == 6, "9999-01-01T00:00:00Z").otherwise(at)
    )
    bag = F.when(defect == 4, F.lit('{"nested":{"no":true}}')).otherwise(
        F.concat(F.lit('{"v":'), F.col("value").cast("string"), F.lit(',"ok":true,"k":'),
                 F.element_at("attr", F.lit("k")), F.lit("}"))
    )
    # NULL members are left out of the text.
    texts = F.to_json(F.struct(
        instant.alias("timestamp"),
        F.when(defect == 0, "critical").otherwise(F.col("level")).alias("level"),
        F.when(defect != 1, F.col("service")).alias("service"),
        F.when(defect == 5, "").otherwise(F.col("message")).alias("message"),
        F.when(defect == 2, 1).alias("extra"),
    ))
    entry = F.concat(F.left(texts, F.length(texts) - 1), F.lit(',"attributes":'), bag, F.lit("}"))
    rows = logs.select(
        F.floor(F.col("event_id") / BATCH_SIZE).cast("string").alias("batch_id"),
        F.struct(F.col("event_id"), entry.alias("entry")).alias("e"),
    )
    bodies = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    return bodies.select(
        "batch_id",
        instants.instant_lit(BATCH_CLOCK).alias("received_at"),
        F.concat(
            F.lit('{"logs":['),
            F.array_join(F.transform("entries", lambda e: e["entry"]), ","),
            F.lit("]}"),
        ).alias("body"),
    )
