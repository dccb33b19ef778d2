"""Joins with markers and saved filters, and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators import matching, run_metrics, validation
from timberline.plans import views
from timberline.plans.ingest_queries import ENTRIES
from timberline.plans.registry import LOGS, iso, query
from timberline.session import scratch_path
from timberline.sources.resources import parse_resource_samples, read_resource_samples

# Every event is a marker sent at its instant. Views never show up; the rest can be read ``value``
# seconds later, so large values miss the deadline.
AUDIT = f"""
WITH {LOGS}, audit AS (
  SELECT 'm-' || CAST(event_id AS VARCHAR) AS marker, {iso('ts')} AS sent_at,
         CASE WHEN event_type <> 'view' THEN CAST(round(value * 1000) AS BIGINT) END AS delay_ms
  FROM logs
)"""


def _markers_and_rows(spark, sf):
    logs = views.logs_from(views.table(spark, sf, "events"), "event_id", "event_type", "value")
    marker = F.concat(F.lit("m-"), F.col("event_id").cast("string"))
    markers = logs.select(marker.alias("marker"), F.col("timestamp").alias("sent_at"))
    delay = F.round(F.col("value") * 1000).cast("bigint")
    stored = logs.where(F.col("event_type") != "view").select(
        marker.alias("attr_marker"),
        instants.from_millis(instants.millis(F.col("timestamp")) + delay).alias("ingested_at"),
    )
    return markers, stored


def _audit(spark, sf):
    return matching.visibility_audit(*_markers_and_rows(spark, sf))


@query(f"{AUDIT} SELECT marker, sent_at, delay_ms, coalesce(delay_ms >= 20000, true) AS failed FROM audit")
def visibility_audit(spark, sf):
    return _audit(spark, sf).select(
        "marker", instants.wire_timestamp(F.col("sent_at")).alias("sent_at"), "delay_ms", "failed"
    )


@query(f"""{AUDIT}
SELECT marker, sent_at, CASE WHEN delay_ms < 20000 THEN delay_ms END AS delay_ms, coalesce(delay_ms >= 20000, true) AS failed FROM audit
""")
def visible_in_time(spark, sf):
    return matching.visible_in_time(*_markers_and_rows(spark, sf)).select(
        "marker", instants.wire_timestamp(F.col("sent_at")).alias("sent_at"), "delay_ms", "failed"
    )


@query(f"""{AUDIT}
SELECT count(*) AS markers, count(*) FILTER (coalesce(delay_ms >= 20000, true)) AS deadline_failures,
       count(*) FILTER (delay_ms IS NULL) AS missing, max(delay_ms) FILTER (delay_ms < 20000) AS max_delay_ms
FROM audit
""")
def visibility_totals(spark, sf):
    return matching.visibility_totals(_audit(spark, sf))


# One saved filter per user: which fields it uses follows from the user number.
SAVED = f"""
WITH {LOGS}, saved AS (
  SELECT c_custkey AS filter_id,
         CASE WHEN c_custkey % 2 = 0 THEN 'svc-' || CAST(c_custkey % 8 AS VARCHAR) END AS service,
         CASE WHEN c_custkey % 3 = 0 THEN list_extract(['debug', 'info', 'warn', 'error'], CAST(c_custkey % 4 + 1 AS INTEGER)) END AS level,
         CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 600 AS INTEGER)) END AS since,
         CASE WHEN c_custkey % 5 > 1 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 600 + c_custkey % 50 AS INTEGER)) END AS until,
         CASE WHEN c_custkey % 7 = 0 THEN 'USER_' || CAST(c_custkey % 10 AS VARCHAR) END AS q,
         CASE WHEN c_custkey % 11 = 0 THEN CAST(c_custkey % 100 AS VARCHAR) END AS attr_k
  FROM customer
)
SELECT saved.filter_id, count(logs.id) AS matches
FROM saved LEFT JOIN logs
  ON (saved.service IS NULL OR logs.service = saved.service)
 AND (saved.level IS NULL OR logs.level = saved.level)
 AND (saved.since IS NULL OR logs.ts >= saved.since)
 AND (saved.until IS NULL OR logs.ts < saved.until)
 AND (saved.q IS NULL OR contains(lower(logs.message), lower(saved.q)))
 AND (saved.attr_k IS NULL OR logs.k = saved.attr_k)
GROUP BY 1
"""


def saved_filters(spark, sf):
    n = F.col("c_custkey")
    hour = 3_600_000
    first = instants.to_millis("2024-01-01T00:00:00Z")
    levels = F.array(*[F.lit(x) for x in ("debug", "info", "warn", "error")])
    since = F.lit(first).cast("bigint") + F.pmod(n, F.lit(600)) * hour
    return views.table(spark, sf, "customer").select(
        n.alias("filter_id"),
        F.when(n % 2 == 0, views.service_of(n)).alias("service"),
        F.when(n % 3 == 0, F.get(levels, F.pmod(n, F.lit(4)).cast("int"))).alias("level"),
        F.when(n % 5 > 0, instants.from_millis(since)).alias("since"),
        F.when(n % 5 > 1, instants.from_millis(since + F.pmod(n, F.lit(50)) * hour)).alias("until"),
        F.when(n % 7 == 0, F.concat(F.lit("USER_"), F.pmod(n, F.lit(10)).cast("string"))).alias("q"),
        F.when(n % 11 == 0, F.create_map(F.lit("k"), F.pmod(n, F.lit(100)).cast("string"))).alias("attr"),
    )


@query(SAVED)
def match_saved_filters(spark, sf):
    return matching.match_saved_filters(views.logs_view(spark, sf), saved_filters(spark, sf))


@query(SAVED)
def match_saved_filters_by_day(spark, sf):
    """The route for filter tables too large to broadcast."""
    return matching.match_saved_filters(views.logs_view(spark, sf), saved_filters(spark, sf), max_broadcast=0)


# Narrow filters, one per supplier: the rows themselves, for a service within two hours.
@query(f"""
WITH {LOGS}, saved AS (
  SELECT s_suppkey AS filter_id, 'svc-' || CAST(s_suppkey % 8 AS VARCHAR) AS service,
         TIMESTAMP '2024-01-01' + to_hours(CAST(s_suppkey * 7 % 700 AS INTEGER)) AS since
  FROM supplier
)
SELECT filter_id, id FROM saved JOIN logs
  ON logs.service = saved.service AND ts >= since AND ts < since + INTERVAL '2 hours' AND contains(lower(message), 'e')
""")
def match_rows(spark, sf):
    hour = 3_600_000
    n = F.col("s_suppkey")
    since = F.lit(instants.to_millis("2024-01-01T00:00:00Z")).cast("bigint") + F.pmod(n * 7, F.lit(700)) * hour
    filters = views.table(spark, sf, "supplier").select(
        n.alias("filter_id"),
        views.service_of(n).alias("service"),
        F.lit(None).cast("string").alias("level"),
        instants.from_millis(since).alias("since"),
        instants.from_millis(since + 2 * hour).alias("until"),
        F.lit("E").alias("q"),
        F.lit(None).cast("map<string,string>").alias("attr"),
    )
    return matching.match_rows(views.logs_view(spark, sf), filters)


QUANTILES = {"med": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
LATENCY_SQL = f"""
SELECT avg(value) AS avg, min(value) AS min,
       {', '.join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in QUANTILES.items())},
       max(value) AS max
FROM (SELECT CAST(round(value * 1000) AS BIGINT) AS value FROM events)
"""


def _latency(spark, sf):
    return views.table(spark, sf, "events").select(F.round(F.col("value") * 1000).cast("bigint").alias("ms"))


@query(LATENCY_SQL)
def latency_summary(spark, sf):
    summary = run_metrics.latency_summary(_latency(spark, sf), "ms", exact=True)
    return summary.select("avg", "min", *[F.round(n, 6).alias(n) for n in QUANTILES], "max")


# A run is the set of batches of one user; views count as not stored.
@query(f"""
WITH {ENTRIES}, offered AS (
  SELECT batch_id, min(service) AS run_id, count(*) AS offered, count(*) FILTER (reason IS NULL) AS accepted,
         count(*) FILTER (reason IS NOT NULL) AS rejected
  FROM entries GROUP BY batch_id
), runs AS (
  SELECT run_id, count(*) AS batches, sum(offered) AS offered, sum(accepted) AS accepted, sum(rejected) AS rejected,
         avg(CASE WHEN accepted = offered THEN 1.0 ELSE 0.0 END) AS success_rate
  FROM offered GROUP BY run_id
), stored AS (
  SELECT run_id, count(*) AS stored FROM entries JOIN offered USING (batch_id)
  WHERE reason IS NULL AND level <> 'debug' GROUP BY run_id
)
SELECT run_id, batches, CAST(offered AS BIGINT) AS offered, CAST(accepted AS BIGINT) AS accepted,
       CAST(rejected AS BIGINT) AS rejected, coalesce(stored, 0) AS stored,
       CAST(accepted - coalesce(stored, 0) AS BIGINT) AS missing, CAST(success_rate AS DOUBLE) AS success_rate
FROM runs LEFT JOIN stored USING (run_id)
""")
def ingest_reconcile(spark, sf):
    validated = validation.validate_envelopes(views.envelopes_view(spark, sf))
    offered = views.logs_from(views.table(spark, sf, "events"), "event_id").groupBy(
        F.floor(F.col("event_id") / views.BATCH_SIZE).cast("string").alias("batch_id")
    ).agg(F.min("service").alias("run_id"), F.count(F.lit(1)).alias("offered"))
    accepted, _ = validation.split_valid(validated)
    stored = accepted.where(F.col("level") != "debug").join(offered.select("batch_id", "run_id"), "batch_id")
    stored = stored.groupBy("run_id").agg(F.count(F.lit(1)).alias("stored"))
    return run_metrics.ingest_reconcile(offered, validation.batch_summary(validated), stored)


@query(f"""
WITH s AS ({LATENCY_SQL}), m AS (
  SELECT 'p95' AS metric, CAST(p95 AS DOUBLE) AS value FROM s UNION ALL SELECT 'max', max FROM s
  UNION ALL SELECT 'avg', avg FROM s UNION ALL SELECT 'min', min FROM s
), rules AS (
  SELECT * FROM (VALUES ('p95', '<', 100000.0), ('max', '<=', 50000.0), ('avg', '>', 0.0), ('min', '>=', 0.0),
                        ('dropped', '==', 0.0)) r(metric, op, bound)
)
SELECT metric, op, CAST(bound AS DOUBLE) AS bound, round(value, 6) AS value,
       coalesce(CASE op WHEN '<' THEN value < bound WHEN '<=' THEN value <= bound WHEN '>' THEN value > bound
                        WHEN '>=' THEN value >= bound ELSE value = bound END, false) AS passed
FROM rules LEFT JOIN m USING (metric)
""")
def slo_check(spark, sf):
    metrics = run_metrics.metric_rows(run_metrics.latency_summary(_latency(spark, sf), "ms", exact=True))
    rules = spark.createDataFrame(
        [("p95", "<", 100000.0), ("max", "<=", 50000.0), ("avg", ">", 0.0), ("min", ">=", 0.0),
         ("dropped", "==", 0.0)],
        "metric string, op string, bound double",
    )
    return run_metrics.slo_check(metrics, rules).withColumn("value", F.round("value", 6))


# Every event is one resource sample of the container named after its type.
@query("""
SELECT event_type AS container, count(*) AS samples,
       round(avg(value), 6) AS avg_cpu_percent, max(value) AS max_cpu_percent,
       round(avg(user_id * 1048576.0), 3) AS avg_memory_bytes, max(user_id * 1048576.0) AS max_memory_bytes,
       CAST(max(user_id % 100) AS DOUBLE) AS max_memory_percent
FROM events GROUP BY 1
""".replace("avg(user_id * 1048576.0)", "avg(CAST(user_id AS DOUBLE) * 1048576)")
   .replace("max(user_id * 1048576.0)", "max(CAST(user_id AS DOUBLE) * 1048576)"))
def resource_summary(spark, sf):
    summary = run_metrics.resource_summary(parse_resource_samples(_raw_samples(spark, sf)))
    return summary.withColumn("avg_cpu_percent", F.round("avg_cpu_percent", 6)).withColumn(
        "avg_memory_bytes", F.round("avg_memory_bytes", 3)
    )


@query("""
SELECT event_type AS container, count(*) AS samples, max(value) AS max_cpu_percent,
       CAST(max(user_id) AS DOUBLE) * 1048576 AS max_memory_bytes
FROM events GROUP BY 1
""")
def resource_samples_from_csv(spark, sf):
    """The same samples, written as CSV text and scanned from there."""
    path = scratch_path(spark, "samples")
    _raw_samples(spark, sf).write.option("header", True).csv(path)
    summary = run_metrics.resource_summary(read_resource_samples(spark, path))
    return summary.select("container", "samples", "max_cpu_percent", "max_memory_bytes")


def _raw_samples(spark, sf):
    return views.table(spark, sf, "events").select(
        instants.wire(instants.naive_millis(F.col("ts"))).alias("timestamp"),
        F.col("event_type").alias("container"),
        F.concat(F.col("value").cast("string"), F.lit("%")).alias("cpu_percent"),
        F.concat(F.col("user_id").cast("string"), F.lit("MiB / 2GiB")).alias("memory_usage"),
        F.concat(F.pmod("user_id", F.lit(100)).cast("string"), F.lit("%")).alias("memory_percent"),
    )


@query(f"""
WITH {LOGS}
SELECT service, count(*) AS records, (epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0 AS seconds,
       round(count(*) / ((epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0), 9) AS per_second
FROM logs GROUP BY 1
""")
def throughput(spark, sf):
    rates = run_metrics.throughput(views.logs_view(spark, sf), F.col("timestamp"), ["service"])
    return rates.withColumn("per_second", F.round("per_second", 9))
