"""Filters and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators import filters as P
from timberline.operators import paging
from timberline.plans import views
from timberline.plans.registry import LOGS, WIRE, iso, query
from timberline.sources.wire import to_wire

SINCE, UNTIL = "2024-01-08T06:30:00.250Z", "2024-01-21T17:45:30.750Z"
SQL_RANGE = "ts >= TIMESTAMP '2024-01-08 06:30:00.250' AND ts < TIMESTAMP '2024-01-21 17:45:30.750'"


def _wire(where: str) -> str:
    return f"WITH {LOGS} SELECT {WIRE} FROM logs WHERE {where}"


@query(_wire("service = 'svc-3'"))
def filter_service(spark, sf):
    return to_wire(P.apply_filters(views.logs_view(spark, sf), P.LogFilter(service="svc-3")))


@query(_wire("service = ''"))
def filter_service_empty_text(spark, sf):
    return to_wire(P.apply_filters(views.logs_view(spark, sf), P.LogFilter(service="")))


@query(_wire("level = 'error'"))
def filter_level(spark, sf):
    return to_wire(P.apply_filters(views.logs_view(spark, sf), P.LogFilter(level="error")))


@query(_wire(SQL_RANGE))
def filter_time_range(spark, sf):
    f = P.LogFilter(since=SINCE, until=UNTIL)
    return to_wire(P.apply_filters(views.logs_view(spark, sf, SINCE, UNTIL), f))


@query(_wire("k = '42'"))
def filter_attr_eq(spark, sf):
    return to_wire(P.apply_filters(views.logs_view(spark, sf), P.LogFilter(attributes={"k": "42"})))


@query(_wire("k = '42'"))
def filter_promoted_attr(spark, sf):
    logs = views.logs_view(spark, sf).withColumn("attr_marker", F.element_at("attr", F.lit("k")))
    return to_wire(P.apply_filters(logs, P.LogFilter(attributes={"marker": "42"})))


@query(_wire("contains(lower(message), lower('USER_1'))"))
def filter_message_literal(spark, sf):
    return to_wire(P.apply_filters(views.logs_view(spark, sf), P.LogFilter(q="USER_1")))


@query(_wire("contains(lower(message), lower('7 100% D'))"))
def filter_message_wildcards(spark, sf):
    return to_wire(P.apply_filters(views.logs_view(spark, sf), P.LogFilter(q="7 100% D")))


@query(_wire(f"service = 'svc-2' AND level = 'info' AND {SQL_RANGE} AND k = '7' AND contains(lower(message), 'click')"))
def filter_conjunction(spark, sf):
    f = P.LogFilter("svc-2", "info", SINCE, UNTIL, "Click", {"k": "7"})
    return to_wire(P.apply_filters(views.logs_view(spark, sf, SINCE, UNTIL), f))


@query(_wire(
    "(ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-05 00:00:00.500') "
    "OR (ts >= TIMESTAMP '2024-01-20 12:00:00.125' AND ts < TIMESTAMP '2024-01-22 00:00:00')"
))
def filter_range_union(spark, sf):
    ranges = [
        ("2024-01-03T00:00:00Z", "2024-01-05T00:00:00.500Z"),
        ("2024-01-20T12:00:00.125Z", "2024-01-22T00:00:00Z"),
    ]
    # The view itself is cut to the span of all ranges; the union picks within it.
    return to_wire(views.logs_view(spark, sf, ranges[0][0], ranges[-1][1]).where(P.range_union(ranges)))


@query("""
SELECT '00000000-0000-7000-8000-' || lpad(lower(to_hex(doc_id)), 12, '0') AS id, source AS service,
       strlen(text) AS bytes
FROM documents WHERE contains(lower(text), lower('OUÈ'))
""")
def message_search_documents(spark, sf):
    docs = P.apply_filters(views.documents_view(spark, sf), P.LogFilter(q="OUÈ"))
    return docs.select("id", "service", F.octet_length("message").cast("bigint").alias("bytes"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS conversation, turn, role
FROM conversations WHERE contains(lower(text), 'tion on')
""")
def message_search_conversations(spark, sf):
    logs = views.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("conversation"), "turn", "role", F.col("text").alias("message")
    )
    return P.apply_filters(logs, P.LogFilter(q="TION on")).drop("message")


# Saved filters as text, one per event; the event number decides what is wrong with each.
def saved_filter_texts(spark, sf):
    events = views.table(spark, sf, "events")
    n = F.pmod("event_id", F.lit(16))
    at = instants.wire(instants.naive_millis(F.col("ts")))
    later = instants.wire(instants.naive_millis(F.col("ts")) + 3_600_000)
    earlier = instants.wire(instants.naive_millis(F.col("ts")) - 1)
    return events.select(
        F.col("event_id").cast("string").alias("filter_id"),
        views.service_of(F.col("user_id")).alias("service"),
        F.when(n == 1, "critical").otherwise(views.level_of(F.col("event_type"))).alias("level"),
        F.when(n == 2, F.replace(at, F.lit("T"), F.lit(" "))).when(n != 3, at).alias("since"),
        F.when(n == 4, earlier).when(n == 5, at).when(n == 6, "soon").otherwise(later).alias("until"),
        F.when(n == 7, "100%").alias("q"),
        F.when(n == 8, "").when(n == 9, "k").alias("attr_k"),
        F.when(n.isin(8, 9), "42").alias("attr_v"),
        F.when(n == 10, "0").when(n == 11, "ten").when(n == 12, "0100").when(n == 13, "1001").alias("limit"),
        F.when(n.isin(0, 3), "1m").when(n == 14, "2m").alias("bucket"),
        F.when(n == 15, "service").when(n == 0, "level").alias("group_by"),
    )


@query(f"""
WITH f AS (
  SELECT event_id, event_id % 16 AS n, epoch_ms(date_trunc('millisecond', ts)) AS ms FROM events
), judged AS (
  SELECT *, CASE n
      WHEN 1 THEN 'invalid level'
      WHEN 2 THEN 'since must be a valid ISO 8601 instant'
      WHEN 3 THEN 'since and until are required'
      WHEN 4 THEN 'until must not be before since'
      WHEN 6 THEN 'until must be a valid ISO 8601 instant'
      WHEN 8 THEN 'invalid attribute key'
      WHEN 10 THEN 'limit must be between 1 and 1000'
      WHEN 11 THEN 'limit must be an integer'
      WHEN 13 THEN 'limit must be between 1 and 1000'
      WHEN 14 THEN 'bucket must be one of: 1m, 5m, 1h, 1d'
      WHEN 15 THEN 'bucket must be one of: 1m, 5m, 1h, 1d'
    END AS reason FROM f
)
SELECT CAST(event_id AS VARCHAR) AS filter_id, reason,
       CASE WHEN reason IS NULL THEN ms END AS since_ms,
       CASE WHEN reason IS NULL THEN CASE n WHEN 5 THEN ms ELSE ms + 3600000 END END AS until_ms,
       CAST(CASE WHEN reason IS NULL AND n <> 0 THEN 100 END AS INTEGER) AS page_limit
FROM judged
""")
def audit_filters(spark, sf):
    audited = P.audit_filters(saved_filter_texts(spark, sf))
    return audited.select("filter_id", "reason", "since_ms", "until_ms", "page_limit")


PAGE = 250
PAGED = f"""
WITH {LOGS}, ordered AS (
  SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn, count(*) OVER () AS total
  FROM logs WHERE service = 'svc-1'
)"""


@query(f"{PAGED} SELECT {WIRE}, CAST(rn AS INTEGER) AS row_no, total > {PAGE} AS has_more FROM ordered WHERE rn <= {PAGE}")
def page_first(spark, sf):
    rows = paging.page_rows(views.logs_view(spark, sf), P.LogFilter(service="svc-1"), PAGE)
    return _wire_page(rows)


def _wire_page(rows):
    return rows.select(
        "id", instants.wire_timestamp(F.col("timestamp")).alias("timestamp"), "level", "service", "message",
        "attributes", "row_no", "has_more",
    )


CURSOR = "2024-01-15T12:00:00.000Z", "00000000-0000-7000-8000-000000000000"


@query(f"""
WITH {LOGS}, ordered AS (
  SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn, count(*) OVER () AS total
  FROM logs WHERE ts < TIMESTAMP '2024-01-15 12:00:00'
)
SELECT {WIRE}, CAST(rn AS INTEGER) AS row_no, total > {PAGE} AS has_more FROM ordered WHERE rn <= {PAGE}
""")
def page_after_cursor(spark, sf):
    # No row of the page is later than the cursor's own millisecond.
    logs = views.logs_view(spark, sf, until=instants.to_millis(CURSOR[0]) + 1)
    return _wire_page(paging.page_rows(logs, P.LogFilter(), PAGE, CURSOR))


def _pages_sql(source: str) -> str:
    return f"""
WITH {LOGS}, source AS ({source}), ordered AS (
  SELECT ts, id, row_number() OVER (ORDER BY ts DESC, id DESC) - 1 AS rn, count(*) OVER () AS total FROM source
)
SELECT CAST(floor(rn / 100) + 1 AS BIGINT) AS page_no, rn % 100 + 1 AS "rows",
       {iso('ts')} AS boundary_ts, id AS boundary_id, rn < total - 1 AS has_more
FROM ordered WHERE rn % 100 = 99 OR rn = total - 1
"""


def _pages(logs):
    return paging.page_table(logs, 100).withColumn(
        "boundary_ts", instants.wire_timestamp(F.col("boundary_ts"))
    )


@query(_pages_sql("SELECT ts, id FROM logs"))
def page_table(spark, sf):
    return _pages(views.logs_view(spark, sf))


@query(_pages_sql("SELECT date_trunc('day', ts) AS ts, id FROM logs"))
def page_table_tied_instants(spark, sf):
    logs = views.logs_view(spark, sf)
    day = instants.bucket_millis(instants.millis(F.col("timestamp")), "1d")
    return _pages(logs.withColumn("timestamp", instants.from_millis(day)))


@query(f"WITH {LOGS} SELECT {WIRE} FROM logs WHERE level IN ('error', 'warn') OR service = 'svc-4'")
def merge_pages(spark, sf):
    logs = views.logs_view(spark, sf)
    held = logs.where(F.col("level").isin("error", "warn"))
    older = P.apply_filters(logs, P.LogFilter(service="svc-4"))
    return to_wire(paging.merge_pages(held, older))


FINGERPRINT = f"""
sha256('{{"endpoint":"logs","service":"' || service || '","level":' ||
       CASE WHEN level = 'error' THEN 'null' ELSE '"' || level || '"' END ||
       ',"since":"' || {iso('ts')} || '","until":null,"q":"100%","attributes":{{"a":"1","k":"' || k || '"}}}}')"""


def _fingerprints(spark, sf):
    logs = views.logs_view(spark, sf)
    attr = F.create_map(F.lit("k"), F.element_at("attr", F.lit("k")), F.lit("a"), F.lit("1"))
    none = F.lit(None).cast("string")
    return logs.select(
        F.col("id").alias("filter_id"),
        paging.filter_fingerprint(
            F.col("service"), F.when(F.col("level") != "error", F.col("level")),
            instants.wire_timestamp(F.col("timestamp")), none, F.lit("100%"), attr,
        ).alias("current_fingerprint"),
    )


@query(f"WITH {LOGS} SELECT id AS filter_id, {FINGERPRINT} AS fingerprint FROM logs")
def filter_fingerprint(spark, sf):
    return _fingerprints(spark, sf).withColumnRenamed("current_fingerprint", "fingerprint")


@query(f"""
WITH {LOGS}
SELECT id AS boundary_id, id AS filter_id,
       CASE WHEN level IN ('error', 'debug') OR service IN ('svc-0', 'svc-1', 'svc-2')
            THEN 'invalid cursor' END AS reason
FROM logs
""")
def check_boundaries(spark, sf):
    prints = _fingerprints(spark, sf)
    saved = views.logs_view(spark, sf).join(prints, F.col("id") == F.col("filter_id")).select(
        F.col("id").alias("boundary_id"),
        "filter_id",
        F.when(F.col("level") == "error", 2).otherwise(1).alias("v"),
        F.when(F.col("service") == "svc-0", "yesterday").otherwise(
            instants.wire_timestamp(F.col("timestamp"))
        ).alias("ts"),
        F.when(F.col("service") == "svc-1", F.concat(F.col("id"), F.lit("0"))).otherwise(F.col("id")).alias("id"),
        F.when(F.col("service") == "svc-2", F.lit("beef"))
        .when(F.col("level") == "debug", F.sha2("current_fingerprint", 256))
        .otherwise(F.col("current_fingerprint")).alias("fingerprint"),
    )
    return paging.check_boundaries(saved, prints)
