"""Validation, the stored table, retention and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators import retention, validation
from timberline.operators.aggregate import count_by_bucket
from timberline.operators.filters import LogFilter
from timberline.plans import views
from timberline.plans.registry import LOGS, bucket, iso, query
from timberline.session import scratch_path
from timberline.sources.envelopes import stream_envelopes
from timberline.sources.log_table import LogTable
from timberline.sources.wire import to_wire
from timberline.streaming.ingest import stream_ingest
from timberline.streaming.live_counts import stream_counts

# The entries of ``envelopes_view`` and their expected fate.
ENTRIES = f"""{LOGS}, numbered AS (
  SELECT *, CAST(event_id // 5 AS VARCHAR) AS batch_id, CAST(event_id % 5 AS INTEGER) AS idx,
         event_id % 20 AS d,
         '{{"k":' || k || ',"ok":true,"v":' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || '}}' AS bag
  FROM logs
), entries AS (
  SELECT *, CASE d
      WHEN 0 THEN 'invalid level: ''critical'''
      WHEN 1 THEN 'missing required field: service'
      WHEN 2 THEN 'unknown field: extra'
      WHEN 3 THEN 'invalid timestamp: expected an ISO 8601 instant'
      WHEN 4 THEN 'attributes must be a flat object with string, number, or boolean values'
      WHEN 5 THEN 'message must not be empty'
      WHEN 6 THEN 'timestamp is more than 5 minutes in the future'
    END AS reason,
    sha256(batch_id || '/' || CAST(idx AS VARCHAR)) AS noise,
    24 + 36 + strlen(level) + strlen(service) + strlen(message) + strlen(bag) AS bytes
  FROM numbered
)"""
V7 = """lpad(lower(to_hex(epoch_ms(TIMESTAMP '2024-02-01'))), 12, '0')"""
NEW_ID = f"""substr({V7}, 1, 8) || '-' || substr({V7}, 9, 4) || '-7' || lpad(lower(to_hex(idx)), 3, '0') || '-' ||
 substr('89ab', CAST(instr('0123456789abcdef', substr(noise, 1, 1)) - 1 AS INTEGER) % 4 + 1, 1) ||
 substr(noise, 2, 3) || '-' || substr(noise, 5, 12)"""


def _validated(spark, sf):
    return validation.validate_envelopes(views.envelopes_view(spark, sf))


@query(f"""
WITH {ENTRIES}
SELECT batch_id, idx, reason, CASE WHEN reason IS NULL THEN {NEW_ID} END AS id,
       CASE WHEN reason IS NULL THEN {iso('ts')} END AS "timestamp",
       CASE WHEN reason IS NULL THEN level END AS level,
       CASE WHEN reason IS NULL THEN service END AS service,
       CASE WHEN reason IS NULL THEN message END AS message,
       CASE WHEN reason IS NULL THEN bag END AS attributes,
       CASE WHEN reason IS NULL THEN k END AS attr_k
FROM entries
""")
def validate_entries(spark, sf):
    v = _validated(spark, sf)
    return v.select(
        "batch_id", "idx", "reason", "id", instants.wire_timestamp(F.col("timestamp")).alias("timestamp"),
        "level", "service", "message", "attributes", F.try_element_at("attr", F.lit("k")).alias("attr_k"),
    )


# One entry per event with one attribute; every fiftieth is of 65,519 to 65,530 characters: as JSON 11 bytes more.
@query("""
SELECT CAST(event_id AS VARCHAR) AS batch_id,
       CASE WHEN event_id % 50 = 0 AND 65519 + event_id // 50 % 12 + 11 > 65536 THEN 'attributes exceed 65536 bytes' END AS reason
FROM events
""")
def validate_attribute_bytes(spark, sf):
    n = F.col("event_id")
    size = F.when(n % 50 == 0, 65_519 + F.call_function("div", n, F.lit(50)) % 12).otherwise(n % 100)
    text = F.repeat(F.lit("x"), size.cast("int"))
    entry = F.concat(
        F.lit('{"logs":[{"timestamp":"2024-01-01T00:00:00Z","level":"info","service":"s","message":"m","attributes":{"text":"'),
        text, F.lit('"}}]}'),
    )
    bodies = views.table(spark, sf, "events").select(
        n.cast("string").alias("batch_id"), instants.instant_lit(views.BATCH_CLOCK).alias("received_at"), entry.alias("body")
    )
    return validation.validate_envelopes(bodies).select("batch_id", "reason")


@query(f"WITH {ENTRIES} SELECT batch_id, idx, reason FROM entries WHERE reason IS NOT NULL")
def split_rejected(spark, sf):
    return validation.split_valid(_validated(spark, sf))[1]


@query(f"""
WITH {ENTRIES}
SELECT batch_id, CASE WHEN count(*) FILTER (reason IS NULL) = 0 THEN 'all_invalid' ELSE 'ok' END AS outcome,
       CAST(NULL AS VARCHAR) AS error,
       count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected_count,
       CAST(coalesce(sum(bytes) FILTER (reason IS NULL), 0) AS BIGINT) AS normalized_bytes,
       '[' || coalesce(string_agg('{{"idx":' || CAST(idx AS VARCHAR) || ',"reason":"' || reason || '"}}', ','
             ORDER BY idx) FILTER (reason IS NOT NULL), '') || ']' AS rejected
FROM entries GROUP BY batch_id
""")
def batch_summary(spark, sf):
    return validation.batch_summary(_validated(spark, sf)).withColumn("rejected", F.to_json("rejected"))


# Bodies that fail as a whole: the status of an order decides how its batch document is broken.
@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS batch_id,
       CASE o_orderstatus WHEN 'F' THEN 'malformed' WHEN 'O' THEN 'bad_envelope' ELSE 'all_invalid' END AS outcome,
       CASE o_orderstatus WHEN 'F' THEN 'malformed JSON'
            WHEN 'O' THEN 'body must be an object containing a logs array' END AS error
FROM orders
""")
def check_envelopes(spark, sf):
    status = F.col("o_orderstatus")
    body = (
        F.when(status == "F", F.concat(F.lit('{"logs":[]} '), F.to_json(F.struct("o_orderkey"))))
        .when(status == "O", F.to_json(F.struct(F.col("o_orderpriority").alias("logs"))))
        .otherwise('{"logs":[]}')
    )
    envelopes = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("batch_id"),
        instants.instant_lit(views.BATCH_CLOCK).alias("received_at"),
        body.alias("body"),
    )
    return validation.batch_summary(validation.validate_envelopes(envelopes)).select("batch_id", "outcome", "error")


@query(f"""
WITH {LOGS}
SELECT id, 24 + 36 + strlen(level) + strlen(service) + strlen(message) + strlen(attributes) AS bytes FROM logs
""")
def normalized_bytes(spark, sf):
    return validation.normalized_bytes(views.logs_view(spark, sf)).select("id", "bytes")


@query(f"""
WITH {LOGS}, t AS (
  SELECT date_trunc('hour', ts) AS ts, CAST(user_id AS VARCHAR) AS id, event_type AS level,
         CASE WHEN service <> 'svc-0' THEN service ELSE '' END AS service,
         CASE WHEN event_type <> 'view' THEN message END AS message,
         CASE WHEN event_type = 'click' THEN '[1]' ELSE attributes END AS attributes FROM logs
)
SELECT 'id_not_null' AS rule, count(*) FILTER (id IS NULL) AS violations FROM t
UNION ALL SELECT 'timestamp_not_null', count(*) FILTER (ts IS NULL) FROM t
UNION ALL SELECT 'level_not_null', count(*) FILTER (level IS NULL) FROM t
UNION ALL SELECT 'service_not_null', count(*) FILTER (service IS NULL) FROM t
UNION ALL SELECT 'message_not_null', count(*) FILTER (message IS NULL) FROM t
UNION ALL SELECT 'attributes_not_null', count(*) FILTER (attributes IS NULL) FROM t
UNION ALL SELECT 'level_known', count(*) FILTER (level NOT IN ('debug', 'info', 'warn', 'error')) FROM t
UNION ALL SELECT 'service_not_empty', count(*) FILTER (service = '') FROM t
UNION ALL SELECT 'message_not_empty', count(*) FILTER (message = '') FROM t
UNION ALL SELECT 'attributes_object', count(*) FILTER (attributes = '[1]') FROM t
UNION ALL SELECT 'key_unique', (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM
  (SELECT count(*) AS c FROM t GROUP BY ts, id))
""")
def constraint_audit(spark, sf):
    logs = views.logs_from(views.table(spark, sf, "events"), "user_id", "event_type")
    hour = instants.bucket_millis(instants.millis(F.col("timestamp")), "1h")
    broken = logs.select(
        instants.from_millis(hour).alias("timestamp"),
        F.col("user_id").cast("string").alias("id"),
        F.col("event_type").alias("level"),
        F.when(F.col("service") != "svc-0", F.col("service")).otherwise("").alias("service"),
        F.when(F.col("event_type") != "view", F.col("message")).alias("message"),
        F.when(F.col("event_type") == "click", "[1]").otherwise(F.col("attributes")).alias("attributes"),
    )
    return validation.constraint_audit(broken)


NOW, DAYS = "2024-01-31T06:00:00.000Z", 10.5
SQL_CUT = "TIMESTAMP '2024-01-20 18:00:00'"


@query(f"WITH {LOGS} SELECT id, {iso('ts')} AS \"timestamp\" FROM logs WHERE ts < {SQL_CUT}")
def retention_expired(spark, sf):
    cut = retention.cutoff(NOW, DAYS)
    gone = retention.expired(views.logs_view(spark, sf, until=cut), cut)
    return gone.select("id", instants.wire_timestamp(F.col("timestamp")).alias("timestamp"))


@query(f"WITH {LOGS} SELECT id, {iso('ts')} AS \"timestamp\" FROM logs WHERE ts >= {SQL_CUT}")
def retention_survivors(spark, sf):
    cut = retention.cutoff(NOW, DAYS)
    kept = retention.survivors(views.logs_view(spark, sf, since=cut), cut)
    return kept.select("id", instants.wire_timestamp(F.col("timestamp")).alias("timestamp"))


@query(f"""
WITH {LOGS}, ordered AS (
  SELECT ts, id, row_number() OVER (ORDER BY ts, id) - 1 AS rn, count(*) OVER () AS total
  FROM logs WHERE ts < {SQL_CUT}
)
SELECT CAST(floor(rn / 2000) + 1 AS BIGINT) AS batch_no, rn % 2000 + 1 AS "rows",
       {iso('ts')} AS last_ts, id AS last_id
FROM ordered WHERE rn % 2000 = 1999 OR rn = total - 1
""")
def retention_plan(spark, sf):
    cut = retention.cutoff(NOW, DAYS)
    plan = retention.retention_plan(views.logs_view(spark, sf, until=cut), cut)
    return plan.withColumn("last_ts", instants.wire_timestamp(F.col("last_ts")))


@query(f"WITH {LOGS} SELECT id FROM logs WHERE level <> 'error'")
def delete_matching(spark, sf):
    logs = views.logs_view(spark, sf)
    return retention.delete_matching(logs, logs.where(F.col("level") == "error")).select("id")


def _stored(spark, sf):
    table = LogTable(spark, scratch_path(spark, "table")).bootstrap()
    table.append(_validated(spark, sf))
    return table


@query(f"""
WITH {ENTRIES}
SELECT {NEW_ID} AS id, {iso('ts')} AS "timestamp", level, service, message, bag AS attributes
FROM entries WHERE reason IS NULL
""")
def write_and_read_logs(spark, sf):
    return to_wire(_stored(spark, sf).read_logs())


@query(f"""
WITH {ENTRIES}
SELECT {iso('ts')} AS "timestamp", service, message FROM entries
WHERE reason IS NULL AND 'm-' || CAST(event_id % 500 AS VARCHAR) = 'm-47'
""")
def stored_marker_lookup(spark, sf):
    """Rows of one value of the stored marker column, found by its own statistics and bloom filter."""
    entry = F.col("batch_id").cast("bigint") * views.BATCH_SIZE + F.col("idx")
    marked = F.map_concat("attr", F.create_map(F.lit("marker"), F.concat(F.lit("m-"), (entry % 500).cast("string"))))
    table = LogTable(spark, scratch_path(spark, "table")).bootstrap()
    table.append(_validated(spark, sf).withColumn("attr", F.when(F.col("attr").isNotNull(), marked)))
    found = table.read_logs(LogFilter(attributes={"marker": "m-47"}))
    return found.select(instants.wire_timestamp(F.col("timestamp")).alias("timestamp"), "service", "message")


@query(f"WITH {ENTRIES} SELECT batch_id, idx, reason FROM entries WHERE reason IS NOT NULL")
def write_and_read_rejects(spark, sf):
    return _stored(spark, sf).rejects().select("batch_id", "idx", "reason")


STORED_COUNTS = f"""
WITH {ENTRIES}
SELECT {bucket('1 hour')} AS start, service AS "group", count(*) AS "count"
FROM entries WHERE reason IS NULL"""


@query(f"{STORED_COUNTS} AND ts >= {SQL_CUT} AND ts < TIMESTAMP '2024-01-29 10:00:00.700' GROUP BY 1, 2")
def apply_retention(spark, sf):
    table = _stored(spark, sf)
    table.apply_retention(NOW, DAYS)
    f = LogFilter(since="2024-01-02T00:00:00.500Z", until="2024-01-29T10:00:00.700Z")
    return table.count_by_bucket(f, "1h", "service")


@query(f"{STORED_COUNTS} GROUP BY 1, 2")
def stream_ingest_accepts(spark, sf):
    source, root = scratch_path(spark, "bodies"), scratch_path(spark, "table")
    views.envelopes_view(spark, sf).select("body").write.text(source)
    table = LogTable(spark, root).bootstrap()
    stream_ingest(
        stream_envelopes(spark, source, whole_files=False), table, f"{root}/checkpoint", drain=True
    ).awaitTermination()
    f = LogFilter(since="2024-01-01T00:00:00Z", until="2024-02-01T00:00:00Z")
    return table.count_by_bucket(f, "1h", "service")


@query(f"""
WITH {ENTRIES}
SELECT count(DISTINCT batch_id) AS batches, count(*) FILTER (reason IS NULL) AS accepted,
       count(*) FILTER (reason IS NOT NULL) AS rejected,
       CAST(sum(bytes) FILTER (reason IS NULL) AS BIGINT) AS normalized_bytes
FROM entries
""")
def stream_reconcile(spark, sf):
    source, root = scratch_path(spark, "bodies"), scratch_path(spark, "table")
    views.envelopes_view(spark, sf).select("body").write.text(source)
    table = LogTable(spark, root).bootstrap()
    stream = stream_envelopes(spark, source, whole_files=False, maxFilesPerTrigger=4)
    stream_ingest(stream, table, f"{root}/checkpoint", drain=True).awaitTermination()
    names = ("batches", "accepted", "rejected", "normalized_bytes")
    return table.commits().agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


@query(f"""
WITH {LOGS}
SELECT {bucket('1 hour')} AS start, service AS "group", count(*) AS "count" FROM logs GROUP BY 1, 2
""")
def stream_counts_equals_batch(spark, sf):
    """Live counts written per micro-batch; the latest value of a window is its largest."""
    views.configure(spark)
    # As a glob, because a stream accepts a folder or a pattern but not the name of one file.
    path = f"{sf}/events.parque[t]"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "checkpoint")

    def write(changed, epoch):
        changed.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("epoch").parquet(out)

    counted = stream_counts(views.logs_from(events), "1h", "service")
    counted.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema("start string, `group` string, count bigint").parquet(out)
    return written.groupBy("start", "group").agg(F.max("count").alias("count"))


# Events before mid-month, then those after it, then the sign-ups of the whole month: most of them come too late.
@query(f"""
WITH {LOGS}, early AS (
  SELECT max(ts) - INTERVAL '2 hours' AS mark FROM logs WHERE event_type <> 'signup'
), kept AS (
  SELECT * FROM logs WHERE event_type <> 'signup' OR time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' > (SELECT mark FROM early)
)
SELECT {bucket('1 hour')} AS start, service AS "group", count(*) AS "count" FROM kept GROUP BY 1, 2
""")
def stream_counts_with_late_rows(spark, sf):
    """Live counts over three micro-batches: a late row inside the watermark corrects its cell, later ones change nothing."""
    source, out, checkpoint = (scratch_path(spark, name) for name in ("logs", "counts", "checkpoint"))
    logs = views.logs_view(spark, sf).select("timestamp", "service", "level", "message")
    late, half = F.startswith("message", F.lit("signup")), instants.instant_lit("2024-01-16T00:00:00Z")
    for part in (~late & (F.col("timestamp") < half), ~late & (F.col("timestamp") >= half), late):
        logs.where(part).coalesce(1).write.mode("append").parquet(source)
        counted = stream_counts(spark.readStream.schema(logs.schema).parquet(source), "1h", "service")

        def write(changed, epoch):
            changed.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("epoch").parquet(out)

        counted.writeStream.outputMode("update").foreachBatch(write).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema("start string, `group` string, count bigint").parquet(out)
    return written.groupBy("start", "group").agg(F.max("count").alias("count"))
