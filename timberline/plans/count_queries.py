"""Bucket counts, the per-second rollup and the report tables derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators import aggregate, paging, reporting, requests, rollup, tiers
from timberline.operators.filters import LogFilter
from timberline.plans import dashboard, views
from timberline.plans.registry import LOGS, bucket, iso, query
from timberline.schema import LEVELS

# Both bounds inside a second, so that both edges of the rollup route have work.
SINCE, UNTIL = "2024-01-01T00:00:07.150Z", "2024-01-30T23:38:03.300Z"
RANGE = LogFilter(since=SINCE, until=UNTIL)
SQL_RANGE = "ts >= TIMESTAMP '2024-01-01 00:00:07.150' AND ts < TIMESTAMP '2024-01-30 23:38:03.300'"


def _counts_sql(interval: str, group: str, where: str = SQL_RANGE) -> str:
    return f"""
WITH {LOGS}
SELECT {bucket(interval)} AS start, {group} AS "group", count(*) AS "count"
FROM logs WHERE {where} GROUP BY 1, 2
"""


def _logs(spark, sf):
    return views.logs_view(spark, sf, SINCE, UNTIL)


@query(_counts_sql("1 minute", "CAST(NULL AS VARCHAR)"))
def count_by_minute(spark, sf):
    return aggregate.count_by_bucket(_logs(spark, sf), RANGE, "1m")


@query(_counts_sql("5 minutes", "level"))
def count_by_5min_level(spark, sf):
    return aggregate.count_by_bucket(_logs(spark, sf), RANGE, "5m", "level")


@query(_counts_sql("1 hour", "service"))
def count_by_hour_service(spark, sf):
    return aggregate.count_by_bucket(_logs(spark, sf), RANGE, "1h", "service")


@query(_counts_sql("1 day", "CAST(NULL AS VARCHAR)"))
def count_by_day(spark, sf):
    return aggregate.count_by_bucket(_logs(spark, sf), RANGE, "1d")


@query(_counts_sql("1 hour", "level", f"{SQL_RANGE} AND k = '42' AND contains(lower(message), 'user_1')"))
def count_by_hour_level_searched(spark, sf):
    f = LogFilter(since=SINCE, until=UNTIL, q="USER_1", attributes={"k": "42"})
    return aggregate.count_by_bucket(_logs(spark, sf), f, "1h", "level")


@query(f"""
SELECT {bucket('1 day', 'o_orderdate')} AS start, o_orderpriority AS "group", count(*) AS "count"
FROM orders GROUP BY 1, 2
""")
def count_orders_by_day(spark, sf):
    f = LogFilter(since="1990-01-01T00:00:00Z", until="2005-01-01T00:00:00Z")
    return aggregate.count_by_bucket(views.orders_view(spark, sf), f, "1d", "service")


@query(f"""
WITH {LOGS}
SELECT CAST(floor(epoch_ms(ts) / 1000) AS BIGINT) AS second, service, level, count(*) AS n
FROM logs GROUP BY 1, 2, 3
""")
def rollup_1s(spark, sf):
    return rollup.rollup_1s(views.logs_view(spark, sf))


@query(_counts_sql("1 hour", "service"))
def aggregate_with_rollup(spark, sf):
    logs = _logs(spark, sf)
    return rollup.aggregate_with_rollup(
        logs, rollup.rollup_1s(logs), RANGE, "1h", "service", covered_from="2024-01-01T00:00:00Z"
    )


@query(_counts_sql("5 minutes", "CAST(NULL AS VARCHAR)", f"{SQL_RANGE} AND service = 'svc-5' AND level = 'info'"))
def aggregate_with_rollup_filtered(spark, sf):
    logs = _logs(spark, sf)
    f = LogFilter("svc-5", "info", SINCE, UNTIL)
    return rollup.aggregate_with_rollup(
        logs, rollup.rollup_1s(logs), f, "5m", covered_from="2024-01-01T00:00:00Z"
    )


@query(_counts_sql("1 hour", "level", f"{SQL_RANGE} AND contains(lower(message), 'view')"))
def aggregate_route_falls_back(spark, sf):
    logs = _logs(spark, sf)
    f = LogFilter(since=SINCE, until=UNTIL, q="view")
    return rollup.aggregate_with_rollup(
        logs, rollup.rollup_1s(logs), f, "1h", "level", covered_from="2024-01-01T00:00:00Z"
    )


CELLS = f"""
WITH {LOGS}, cells AS (
  SELECT CAST(tier AS INTEGER) AS tier, CAST(floor(epoch_ms(ts) / 1000) AS BIGINT) // tier * tier AS start, service, level, count(*) AS n
  FROM logs CROSS JOIN (VALUES (1), (60), (3600), (86400)) t(tier) GROUP BY ALL
)"""


@query(f"{CELLS} SELECT tier, CAST(start AS BIGINT) AS start, service, level, n FROM cells")
def rollup_tiers(spark, sf):
    return tiers.cells_of(views.logs_view(spark, sf))


@query(_counts_sql("1 hour", "service"))
def aggregate_with_tiers(spark, sf):
    logs = _logs(spark, sf)
    return tiers.aggregate_with_tiers(logs, tiers.cells_of(logs), RANGE, "1h", "service")


@query(_counts_sql("1 day", "level", f"{SQL_RANGE} AND service = 'svc-5'"))
def aggregate_with_tiers_by_day(spark, sf):
    """Finer tiers are evicted: what they no longer cover comes from the rows."""
    logs = _logs(spark, sf)
    now = "2024-01-30T23:59:00Z"
    cells = tiers.evict_tiers(tiers.cells_of(logs), now)
    f = LogFilter("svc-5", None, SINCE, UNTIL)
    return tiers.aggregate_with_tiers(logs, cells, f, "1d", "level", tiers.coverage(now))


@query(f"""{CELLS}
SELECT tier, CAST(start AS BIGINT) AS start, service, level, n FROM cells
WHERE start >= CASE tier WHEN 1 THEN epoch(TIMESTAMP '2024-01-20 08:00:00') WHEN 60 THEN epoch(TIMESTAMP '2024-01-18 10:00:00')
                         WHEN 3600 THEN epoch(TIMESTAMP '2023-10-20 10:00:00') ELSE 0 END
""")
def evict_tiers(spark, sf):
    return tiers.evict_tiers(tiers.cells_of(views.logs_view(spark, sf)), NOW)


NOW = "2024-01-20T10:00:00.900Z"


@query(f"""
WITH {LOGS}
SELECT id, {iso('ts')} AS "timestamp" FROM logs WHERE ts >= TIMESTAMP '2024-01-20 08:00:00'
""")
def read_recent(spark, sf):
    recent = rollup.read_recent(views.logs_view(spark, sf, rollup.coverage_start(NOW)), NOW)
    return recent.select("id", instants.wire_timestamp(F.col("timestamp")).alias("timestamp"))


@query(f"""
WITH {LOGS}
SELECT CAST(floor(epoch_ms(ts) / 1000) AS BIGINT) AS second, service, level, count(*) AS n
FROM logs WHERE ts >= TIMESTAMP '2024-01-20 08:00:00' GROUP BY 1, 2, 3
""")
def evict_rollup(spark, sf):
    return rollup.evict_rollup(rollup.rollup_1s(views.logs_view(spark, sf, rollup.coverage_start(NOW))), NOW)


@query(f"""
WITH {LOGS}, parts AS (
  SELECT time_bucket(INTERVAL '1 day', ts) AS b, level, count(*) AS c FROM logs WHERE level = 'error' GROUP BY 1, 2
  UNION ALL
  SELECT time_bucket(INTERVAL '1 day', ts) AS b, level, count(*) AS c FROM logs WHERE level <> 'error' GROUP BY 1, 2
)
SELECT {iso('b')} AS start, level AS "group", CAST(sum(c) AS BIGINT) AS "count" FROM parts GROUP BY 1, 2
""")
def union_partials(spark, sf):
    logs = views.logs_view(spark, sf)
    parts = [
        aggregate.bucket_counts(logs.where(F.col("level") == "error"), "1d", "level"),
        aggregate.bucket_counts(logs.where(F.col("level") != "error"), "1d", "level"),
    ]
    return aggregate.present(rollup.union_partials(*parts))


def _hourly(spark, sf, group_by):
    """Hourly counts of all rows."""
    return aggregate.present(aggregate.bucket_counts(views.logs_view(spark, sf), "1h", group_by), ordered=False)


HOURLY_LEVEL = f"""
WITH {LOGS}, counted AS (
  SELECT {bucket('1 hour')} AS start, level AS g, count(*) AS c FROM logs GROUP BY 1, 2
)"""
HOURLY_SERVICE = HOURLY_LEVEL.replace("level AS g", "service AS g")


@query(f'{HOURLY_SERVICE} SELECT g AS "group", CAST(sum(c) AS BIGINT) AS "count" FROM counted '
       "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_services(spark, sf):
    return reporting.top_services(_hourly(spark, sf, "service"))


@query(f"{HOURLY_LEVEL} SELECT DISTINCT start FROM counted")
def distinct_starts(spark, sf):
    return aggregate.distinct_starts(_hourly(spark, sf, "level"))


@query(f"""{HOURLY_LEVEL}
SELECT start, {', '.join(f"CAST(coalesce(sum(c) FILTER (g = '{x}'), 0) AS BIGINT) AS {x}" for x in LEVELS)},
       CAST(sum(c) AS BIGINT) AS total
FROM counted GROUP BY start
""")
def level_series(spark, sf):
    return reporting.level_series(_hourly(spark, sf, "level"))


SERVICE_SERIES = f"""{HOURLY_SERVICE}, ranked AS (
  SELECT g, row_number() OVER (ORDER BY sum(c) DESC, g) AS rn, count(*) OVER () AS groups FROM counted GROUP BY g
), names AS (
  SELECT DISTINCT CASE WHEN rn <= 5 THEN g ELSE 'Other' END AS series,
         CAST(least(rn, 6) AS INTEGER) AS series_no FROM ranked
), grid AS (
  SELECT s.start, n.series, n.series_no FROM (SELECT DISTINCT start FROM counted) s CROSS JOIN names n
), summed AS (
  SELECT start, CASE WHEN rn <= 5 THEN counted.g ELSE 'Other' END AS series, CAST(sum(c) AS BIGINT) AS v
  FROM counted JOIN ranked ON counted.g = ranked.g GROUP BY 1, 2
), series AS (
  SELECT grid.start, grid.series, grid.series_no, coalesce(v, 0) AS value
  FROM grid LEFT JOIN summed ON grid.start = summed.start AND grid.series = summed.series
)"""


@query(f"{SERVICE_SERIES} SELECT * FROM series")
def service_series_other(spark, sf):
    return reporting.service_series(_hourly(spark, sf, "service"))


@query(f"""{SERVICE_SERIES}
SELECT *, CAST(coalesce(sum(value) OVER (
  PARTITION BY start ORDER BY series_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM series
""")
def stack_offsets(spark, sf):
    return reporting.stack_offsets(reporting.service_series(_hourly(spark, sf, "service")))


@query(f"""{HOURLY_LEVEL}, per_start AS (
  SELECT start, sum(c) AS n, coalesce(sum(c) FILTER (g = 'error'), 0) AS e FROM counted GROUP BY start
)
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS peak,
       CAST(sum(e) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS error_share
FROM per_start
""")
def totals_peak_error_share(spark, sf):
    counted = _hourly(spark, sf, "level")
    both = aggregate.totals(counted).withColumn("_one", F.lit(1)).join(
        aggregate.error_share(counted).withColumn("_one", F.lit(1)), "_one"
    )
    return both.drop("_one")


@query(f"""
WITH {LOGS}
SELECT id, 'k=' || k AS preview, CAST(1 AS INTEGER) AS more FROM logs
""")
def attribute_preview(spark, sf):
    logs = views.logs_view(spark, sf)
    attr = F.map_concat("attr", F.create_map(F.lit("level"), F.col("level")))
    return reporting.attribute_preview(logs.withColumn("attr", attr)).select("id", "preview", "more")


# One report request per event; the event number decides which range it asks for.
@query(f"""
WITH e AS (
  SELECT event_id, event_id % 9 AS n, epoch_ms(date_trunc('millisecond', ts)) AS ms FROM events
), r AS (
  SELECT event_id, n, CASE WHEN n IN (6, 7) THEN ms ELSE epoch_ms(TIMESTAMP '2024-02-01') -
           CASE n WHEN 0 THEN 900000 WHEN 1 THEN 3600000 WHEN 2 THEN 21600000 WHEN 3 THEN 86400000
                  WHEN 4 THEN 604800000 WHEN 5 THEN 2592000000 END END AS s,
         CASE WHEN n = 6 THEN ms + 1000 * event_id + 1 WHEN n = 7 THEN ms WHEN n < 6
              THEN epoch_ms(TIMESTAMP '2024-02-01') END AS u
  FROM e
), j AS (
  SELECT *, CASE WHEN s IS NULL OR u IS NULL THEN 'Choose valid start and end times.'
                 WHEN u <= s THEN 'The end time must be after the start time.' END AS reason FROM r
)
SELECT CAST(event_id AS VARCHAR) AS request_id,
       CASE WHEN reason IS NULL THEN s END AS since_ms, CASE WHEN reason IS NULL THEN u END AS until_ms,
       CASE WHEN reason IS NOT NULL THEN NULL WHEN u - s <= 7200000 THEN '1m' WHEN u - s <= 43200000 THEN '5m'
            WHEN u - s <= 604800000 THEN '1h' ELSE '1d' END AS bucket, reason
FROM j
""")
def resolve_requests(spark, sf):
    n = F.pmod("event_id", F.lit(9))
    ranges = F.array(*[F.lit(r) for r in ("15m", "1h", "6h", "24h", "7d", "30d", "custom", "custom", "2w")])
    ms = instants.naive_millis(F.col("ts"))
    until = F.when(n == 6, instants.wire(ms + 1000 * F.col("event_id") + 1)).otherwise(instants.wire(ms))
    requests = views.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("request_id"),
        F.get(ranges, n.cast("int")).alias("range"),
        instants.wire(ms).alias("since"),
        until.alias("until"),
    )
    now = F.lit(instants.to_millis("2024-02-01T00:00:00Z")).cast("bigint")
    return reporting.resolve_requests(requests, now).select("request_id", "since_ms", "until_ms", "bucket", "reason")


# Of these requests every fifth is kept to one service, every third to one level, and their groupings take turns.
ANSWERS = f"""
WITH {LOGS}, r AS (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'svc-' || CAST(event_id % 8 AS VARCHAR) END AS service,
         CASE WHEN event_id % 3 = 0 THEN list_extract(['debug', 'info', 'warn', 'error'], CAST(event_id % 4 + 1 AS INTEGER)) END AS level,
         CASE event_id % 7 WHEN 0 THEN 'service' WHEN 1 THEN 'level' END AS group_by,
         epoch_ms(date_trunc('millisecond', ts)) AS hi,
         list_extract([900000, 3600000, 21600000, 86400000, 604800000, 1], CAST(event_id % 6 + 1 AS INTEGER)) + event_id % 1000 AS span
  FROM events
), sized AS (
  SELECT *, hi - span AS lo, CASE WHEN span <= 7200000 THEN 60000 WHEN span <= 43200000 THEN 300000 WHEN span <= 604800000 THEN 3600000
         ELSE 86400000 END AS size FROM r
)
SELECT CAST(sized.event_id AS VARCHAR) AS request_id, {iso('make_timestamp((epoch_ms(ts) - epoch_ms(ts) % size) * 1000)')} AS start,
       CASE group_by WHEN 'service' THEN logs.service WHEN 'level' THEN logs.level END AS "group", count(*) AS "count"
FROM sized JOIN logs ON epoch_ms(ts) >= lo AND epoch_ms(ts) < hi
 AND (sized.service IS NULL OR logs.service = sized.service) AND (sized.level IS NULL OR logs.level = sized.level)
GROUP BY 1, 2, 3
"""


@query(ANSWERS)
def answer_requests(spark, sf):
    """One request per event, up to a week back from its instant, all answered together."""
    n = F.col("event_id")
    spans = F.array(*[F.lit(x) for x in (900_000, 3_600_000, 21_600_000, 86_400_000, 604_800_000, 1)])
    hi = instants.naive_millis(F.col("ts"))
    span = F.get(spans, F.pmod(n, F.lit(6)).cast("int")) + F.pmod(n, F.lit(1000))
    asked = views.table(spark, sf, "events").select(
        n.cast("string").alias("request_id"), F.lit("custom").alias("range"),
        instants.wire(hi - span).alias("since"), instants.wire(hi).alias("until"),
        F.when(n % 5 == 0, views.service_of(n)).alias("service"),
        F.when(n % 3 == 0, F.get(F.array(*[F.lit(x) for x in LEVELS]), F.pmod(n, F.lit(4)).cast("int"))).alias("level"),
        F.when(n % 7 == 0, "service").when(n % 7 == 1, "level").alias("group_by"),
    )
    logs = views.logs_view(spark, sf)
    columns = asked.select("request_id", "service", "level", "group_by", "range", "since", "until")
    resolved = reporting.resolve_requests(columns, F.lit(0).cast("bigint"))
    return requests.answer_requests(resolved, logs, tiers.cells_of(logs))


BOARD_NOW = "2024-01-31T00:00:00.000Z"


def _board_logs(spark, sf):
    return views.logs_view(spark, sf, "2024-01-01T00:00:00Z", BOARD_NOW)


BOARD = f"""
WITH {LOGS}, seen AS (
  SELECT * FROM logs WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' AND service = 'svc-6'
), per_level AS (
  SELECT {bucket('1 day')} AS start, level, count(*) AS c FROM seen GROUP BY 1, 2
), per_start AS (
  SELECT start, sum(c) AS n, coalesce(sum(c) FILTER (level = 'error'), 0) AS e FROM per_level GROUP BY 1
), m AS (
  SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(max(n) AS DOUBLE) AS peak,
         CAST(sum(e) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS error_share FROM per_start
)
SELECT 'series' AS panel, s.start, l.level AS series, CAST(coalesce(c, 0) AS DOUBLE) AS value
FROM per_start s CROSS JOIN (VALUES ('debug'), ('info'), ('warn'), ('error')) l(level)
LEFT JOIN per_level p ON p.start = s.start AND p.level = l.level
UNION ALL SELECT 'metric', NULL, 'total', total FROM m
UNION ALL SELECT 'metric', NULL, 'peak', peak FROM m
UNION ALL SELECT 'metric', NULL, 'error_share', error_share FROM m
UNION ALL SELECT * FROM (
  SELECT 'latest', {iso('ts')}, id, CAST(NULL AS DOUBLE) FROM seen ORDER BY ts DESC, id DESC LIMIT 100
)
"""


@query(BOARD)
def dashboard_report(spark, sf):
    report = dashboard.dashboard_report(
        _board_logs(spark, sf), LogFilter(service=" svc-6 ", q="  "), BOARD_NOW, "30d", "level"
    )
    return dashboard.as_rows(report)


@query(BOARD)
def dashboard_from_tiers(spark, sf):
    logs = _board_logs(spark, sf)
    report = dashboard.dashboard_report(
        logs, LogFilter(service="svc-6"), BOARD_NOW, "30d", "level", cells=tiers.cells_of(logs)
    )
    return dashboard.as_rows(report)


@query(f"""
WITH {LOGS}, ordered AS (
  SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn, count(*) OVER () AS total FROM logs
  WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31' AND service = 'svc-6'
)
SELECT id, {iso('ts')} AS "timestamp", CAST(rn - 40 AS INTEGER) AS row_no, total > 80 AS has_more FROM ordered WHERE rn BETWEEN 41 AND 80
""")
def dashboard_second_page(spark, sf):
    """The rows of a board continued from its first page, on the board's own range."""
    logs = _board_logs(spark, sf)
    report = dashboard.dashboard_report(logs, LogFilter(service="svc-6"), BOARD_NOW, "30d", limit=40)
    rows = paging.page_rows(logs, report.filter, 40, report.page().boundary)
    return rows.select("id", instants.wire_timestamp(F.col("timestamp")).alias("timestamp"), "row_no", "has_more")
