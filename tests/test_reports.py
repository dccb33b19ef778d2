import pytest
from helpers import make_logs, plan_text
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators import matching, reporting, retention, run_metrics
from timberline.operators.filters import LogFilter
from timberline.plans import dashboard
from timberline.sources import resources, wire

START = "2026-08-15T12:00:00.000Z"
COUNTED = "start string, `group` string, count bigint"


def test_service_series_golden(spark):
    counted = spark.createDataFrame([(START, g, n) for g, n in zip("abcdef", range(10, 4, -1))], COUNTED)
    rows = reporting.service_series(counted).orderBy("series_no").collect()
    assert [(r["series"], r["value"]) for r in rows] == [
        ("a", 10), ("b", 9), ("c", 8), ("d", 7), ("e", 6), ("Other", 5)
    ]
    offsets = reporting.stack_offsets(reporting.service_series(counted)).orderBy("series_no").collect()
    assert [r["offset"] for r in offsets] == [0, 10, 19, 27, 34, 40]


def test_service_series_without_rest_and_with_gaps(spark):
    counted = spark.createDataFrame([(START, "b", 2), (START, "a", 2), ("later", "a", 1)], COUNTED)
    rows = reporting.service_series(counted).orderBy("start", "series_no").collect()
    assert [tuple(r) for r in rows] == [
        (START, "a", 1, 2), (START, "b", 2, 2), ("later", "a", 1, 1), ("later", "b", 2, 0)
    ]


def test_group_named_like_the_rest_shares_its_series(spark):
    counted = spark.createDataFrame([(START, g, 10 - i) for i, g in enumerate(["a", "Other", "c", "d", "e", "f"])], COUNTED)
    rows = reporting.service_series(counted).where("series = 'Other'").collect()
    assert [(r["series_no"], r["value"]) for r in rows] == [(2, 9 + 5)]


def test_level_series_fills_missing_levels(spark):
    counted = spark.createDataFrame([(START, "info", 8), (START, "error", 2)], COUNTED)
    assert tuple(reporting.level_series(counted).first()) == (START, 0, 8, 0, 2, 10)


@pytest.mark.parametrize("duration, bucket", [
    (7_200_000, "1m"), (7_200_001, "5m"), (43_200_000, "5m"), (43_200_001, "1h"), (604_800_000, "1h"), (604_800_001, "1d"),
])
def test_bucket_choice(spark, duration, bucket):
    assert spark.range(1).select(reporting.bucket_for(F.lit(duration))).first()[0] == bucket
    assert dashboard.resolve_range(duration, "custom", 0, duration)[2] == bucket


def test_range_presets():
    now = instants.to_millis(START)
    assert dashboard.resolve_range(START, "1h", None, None) == (now - 3_600_000, now, "1m")
    with pytest.raises(ValueError):
        dashboard.resolve_range(START, "custom", START, START)
    with pytest.raises(ValueError):
        dashboard.resolve_range(START, "custom", None, START)


@pytest.mark.parametrize("group", ["level", "service"])
def test_dashboard_metrics(spark, group):
    at = instants.to_millis(START) - 1_000
    logs = make_logs(spark, [(n, at, "error" if n < 2 else "info", f"s{n % 3}", "m", {}) for n in range(10)])
    report = dashboard.dashboard_report(logs, LogFilter(service="  ", q=""), START, "1h", group)
    assert tuple(report.metrics.first()) == (10, 10, 0.2)
    assert report.series.agg(F.sum("value")).first()[0] == 10 and report.latest.count() == 10
    empty = dashboard.dashboard_report(logs.limit(0), LogFilter(), START)
    assert tuple(empty.metrics.first()) == (0, 0, None)


def test_wire_form(spark):
    logs = make_logs(spark, [(1, "2026-07-20T14:00:00.007Z", "info", "s", 'say "hi"', {"a": "1"})])
    assert wire.to_wire(logs).first()["timestamp"] == "2026-07-20T14:00:00.007Z"
    line = wire.to_json_lines(logs).first()["value"]
    assert line.endswith('"message":"say \\"hi\\"","attributes":{"a":"1"}}')


def test_retention_edge_and_plan(spark):
    now = "2026-08-15T12:00:00Z"
    cut = retention.cutoff(now, 0.5)
    assert cut == instants.to_millis(now) - 43_200_000
    logs = make_logs(spark, [(n, cut - 5 + n, "info", "s", "m", {}) for n in range(8)])
    assert retention.expired(logs, cut).count() == 5 and retention.survivors(logs, cut).count() == 3
    plan = retention.retention_plan(logs, cut, batch=2, partitions=3).orderBy("batch_no").collect()
    assert [(r["batch_no"], r["rows"], int(r["last_id"][-1])) for r in plan] == [(1, 2, 1), (2, 2, 3), (3, 1, 4)]
    with pytest.raises(ValueError):
        retention.cutoff(now, 0)
    keys = retention.expired(logs, cut)
    dated = logs.withColumn("event_date", instants.event_date(F.col("timestamp")))
    for table in (logs, dated):
        assert retention.delete_matching(table, keys).count() == 3 and retention.matching(table, keys).count() == 5


def test_visibility(spark):
    markers = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 0)], "marker string, ms bigint").select(
        "marker", F.timestamp_millis("ms").alias("sent_at")
    )
    logs = spark.createDataFrame(
        [("a", 500), ("a", 900), ("b", 19_999), ("c", 20_000), (None, 1)], "attr_marker string, ms bigint"
    ).select("attr_marker", F.timestamp_millis("ms").alias("ingested_at"))
    large = matching.visibility_audit(markers, logs, max_broadcast=1)
    audit = matching.visibility_audit(markers, logs)
    assert {tuple(r) for r in large.collect()} == {tuple(r) for r in audit.collect()}
    assert {r["marker"]: (r["delay_ms"], r["failed"]) for r in audit.collect()} == {
        "a": (500, False), "b": (19_999, False), "c": (20_000, True), "d": (None, True)
    }
    assert tuple(matching.visibility_totals(audit).first()) == (4, 2, 1, 19_999)


def test_visible_in_time_reads_no_later_rows(spark, tmp_path):
    markers = spark.createDataFrame(
        [("a", 0), ("a", 30_000), ("b", 19_999), ("c", 5), ("d", 1), ("e", 7), ("e", 7), (None, 3), ("f", None)], "marker string, ms bigint"
    ).select("marker", F.timestamp_millis("ms").alias("sent_at"))
    rows = [("a", 500), ("a", 900), ("a", 40_000), ("b", 39_998), ("b", 10), ("c", 20_005), ("d", 999_999), ("e", 7), ("f", 2), (None, 4)]
    spark.createDataFrame(rows, "attr_marker string, ms bigint").select(
        "attr_marker", F.timestamp_millis("ms").alias("ingested_at")
    ).write.parquet(str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    found = matching.visible_in_time(markers, logs)
    got = sorted((r["marker"] or "", r["delay_ms"], r["failed"]) for r in found.select("marker", "delay_ms", "failed").collect() if not r["failed"])
    assert got == [("a", 500, False), ("a", 10_000, False), ("b", 19_999, False), ("e", 0, False), ("e", 0, False)]
    late = {r["marker"] for r in found.where("failed").collect()}
    assert late == {"c", "d", None, "f"} and found.count() == 9 and found.where("failed AND seen_at IS NOT NULL").count() == 0
    assert tuple(matching.visibility_totals(found).first())[:2] == (9, 4)
    plan = plan_text(found)
    assert "GreaterThanOrEqual(ingested_at,1970-01-01" in plan and "LessThan(ingested_at,1970-01-01" in plan
    assert matching.visible_in_time(markers.limit(0), logs).count() == 0


FILTERS = "filter_id int, service string, level string, since timestamp, until timestamp, q string, attr map<string,string>"


@pytest.mark.parametrize("max_broadcast", [100, 0])
def test_saved_filters_against_each_filter_alone(spark, max_broadcast):
    from datetime import datetime, timezone

    from timberline.operators.filters import apply_filters

    day = 86_400_000
    logs = make_logs(spark, [
        (n, n * day // 7, ["info", "error"][n % 2], f"s{n % 3}", f"Message {n % 5}%", {"k": str(n % 4)}) for n in range(60)
    ]).cache()

    def at(ms):
        return datetime.fromtimestamp(ms / 1000, timezone.utc)

    filters = [
        LogFilter(), LogFilter(service="s1"), LogFilter(level="error"), LogFilter("s2", "info"), LogFilter(q="AGE 3%"),
        LogFilter(since=2 * day), LogFilter(until=3 * day + 1), LogFilter(since=day, until=day), LogFilter("s0", None, day, 4 * day, "message", {"k": "2"}),
        LogFilter(attributes={"k": "1", "missing": "x"}), LogFilter(service=""), LogFilter(since=day, until=5 * day, attributes={"k": "3"}),
    ]
    rows = [
        (i, f.service, f.level, None if f.since is None else at(f.since), None if f.until is None else at(f.until), f.q, f.attributes or None)
        for i, f in enumerate(filters)
    ]
    table = spark.createDataFrame(rows, FILTERS)
    expected = {i: {r["id"] for r in apply_filters(logs, f).collect()} for i, f in enumerate(filters)}
    found = matching.match_saved_filters(logs, table, max_broadcast).collect()
    assert {r["filter_id"]: r["matches"] for r in found} == {i: len(ids) for i, ids in expected.items()}
    pairs = [tuple(r) for r in matching.match_rows(logs, table, max_broadcast).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, n) for i, ids in expected.items() for n in ids}
    assert matching.match_saved_filters(logs.limit(0), table, max_broadcast).agg(F.sum("matches")).first()[0] == 0
    assert matching.match_rows(logs.limit(0), table).count() == 0
    twice = matching.match_saved_filters(logs, table.unionByName(table.where("filter_id IN (0, 4)").withColumn("service", F.lit("s1"))), max_broadcast)
    assert sorted(r["matches"] for r in twice.where("filter_id = 0").collect()) == [20, 60]
    assert matching.match_saved_filters(logs, table.limit(0)).count() == 0


def test_tests_are_looked_up_at_their_rarest_feature(spark, monkeypatch):
    """Each test meets only rows that hold its anchor, days that lack a feature are left out, hot places are split."""
    hour = 3_600_000
    texts = ["common words here", "common words ÄÖÜ", "rare zebra here", "x", "", "zz" + "common " * 300]
    logs = make_logs(spark, [(n, n * hour, "info", "s", texts[n % 6], {"k": str(n % 3), "a:b": "c"}) for n in range(240)]).cache()
    rows = [
        (0, "ZEBRA"), (1, "common"), (2, "äöü"), (3, "x"), (4, ""), (5, "not there"), (6, "common words"), (7, "mon com"), (8, "zzc"),
    ]
    table = spark.createDataFrame([(i, None, None, None, None, q, None) for i, q in rows], FILTERS)
    pairs = spark.createDataFrame([(20, None, None, None, None, "here", {"k": "2"}), (21, None, None, None, None, None, {"a:b": "c", "k": "1"})], FILTERS)
    monkeypatch.setattr(matching, "ROWS_PER_SALT", 3)
    monkeypatch.setattr(matching, "TRIED", 0)
    wanted = matching._wanted(table.unionByName(pairs))
    anchors = matching.anchors_of(logs, matching._tests(wanted), 0).join(wanted.select("test", "filter_id"), "test")
    of = {r["filter_id"]: r for r in anchors.groupBy("filter_id").agg(F.collect_set("feature").alias("f"), F.max("n").alias("n")).collect()}
    assert 5 not in of and of[0]["f"][0] in {"tzeb", "tebr", "tbra"} and of[3]["f"] == [""] and of[0]["n"] == 4
    folded = [t.lower() for t in texts]
    expected = {i: 40 * sum(q.lower() in t for t in folded) for i, q in rows} | {20: 40, 21: 80}
    for most in (0, 1000):
        found = matching.match_saved_filters(logs, table.unionByName(pairs), most).collect()
        assert {r["filter_id"]: r["matches"] for r in found} == expected
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(matching._looked_up(logs, matching._tests(wanted), 0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin Inner" in plan and "BroadcastHashJoin" not in plan


def test_bounds_inside_hours(spark):
    at = [0, 1, 999, 1000, 3_599_999, 3_600_000, 3_600_001, 7_300_500, 7_300_500]
    logs = make_logs(spark, [(n, t, "info", None if n == 2 else "s", "m", {}) for n, t in enumerate(at)])
    bounds = [(lo, hi) for lo in (0, 1, 1000, 3_599_999, 7_300_500) for hi in (1, 1000, 3_600_000, 3_600_001, 7_300_501)]
    rows = [(i, lo, hi, ["s", None][i % 2]) for i, (lo, hi) in enumerate(bounds)]
    table = spark.createDataFrame(rows, "filter_id int, lo bigint, hi bigint, service string").select(
        "filter_id", "service", F.lit(None).cast("string").alias("level"), F.timestamp_millis("lo").alias("since"),
        F.timestamp_millis("hi").alias("until"), F.lit(None).cast("string").alias("q"), F.lit(None).cast("map<string,string>").alias("attr"),
    )
    found = {r["filter_id"]: r["matches"] for r in matching.match_saved_filters(logs, table).collect()}
    assert found == {i: sum(lo <= t < hi and not (s and n == 2) for n, t in enumerate(at)) for i, lo, hi, s in rows}


def test_resource_samples(spark, tmp_path):
    path = tmp_path / "resources.csv"
    path.write_text(
        "timestamp,container,cpu_percent,memory_usage,memory_percent\n"
        "2026-07-20T14:00:00.000Z,api,12.34%,100MiB / 256MiB,39.06%\n"
        "2026-07-20T14:00:01.000Z,api,37.66%,0.5GiB / 1GiB,50.00%\n"
        "2026-07-20T14:00:01.000Z,db,--,512B / 1kB,1%\n"
    )
    samples = resources.read_resource_samples(spark, str(path))
    rows = {r["container"]: r for r in run_metrics.resource_summary(samples).collect()}
    assert rows["api"]["avg_cpu_percent"] == pytest.approx(25.0) and rows["api"]["max_cpu_percent"] == 37.66
    assert rows["api"]["max_memory_bytes"] == 2**29 and rows["db"]["max_memory_bytes"] == 512
    assert rows["db"]["avg_cpu_percent"] is None


def test_run_reports(spark):
    offered = spark.createDataFrame([("r", "b1", 5), ("r", "b2", 5), ("q", "b3", 1)], "run_id string, batch_id string, offered bigint")
    summaries = spark.createDataFrame([("b1", 5, 0), ("b2", 3, 2)], "batch_id string, accepted bigint, rejected_count bigint")
    stored = spark.createDataFrame([("r", 7), ("z", 1)], "run_id string, stored bigint")
    rows = {r["run_id"]: r for r in run_metrics.ingest_reconcile(offered, summaries, stored).collect()}
    assert tuple(rows["r"])[1:] == (2, 10, 8, 2, 7, 1, 0.5)
    assert tuple(rows["q"])[1:] == (1, 1, 0, 0, 0, 0, 0.0)
    assert tuple(rows["z"])[1:] == (0, 0, 0, 0, 1, -1, None)

    metrics = spark.createDataFrame([("p95", 900.0), ("failures", 1.0)], "metric string, value double")
    rules = spark.createDataFrame(
        [("p95", "<", 1000.0), ("failures", "==", 0.0), ("dropped", "==", 0.0)], "metric string, op string, bound double"
    )
    assert {r["metric"]: r["passed"] for r in run_metrics.slo_check(metrics, rules).collect()} == {
        "p95": True, "failures": False, "dropped": False
    }
    spans = spark.createDataFrame([("a", 0), ("a", 2_000), ("b", 0)], "k string, ms bigint").withColumn("t", F.timestamp_millis("ms"))
    rates = {r["k"]: r["per_second"] for r in run_metrics.throughput(spans, F.col("t"), ["k"]).collect()}
    assert rates == {"a": 1.0, "b": None}
    approx = run_metrics.latency_summary(spark.range(1, 101).withColumnRenamed("id", "ms"), "ms", exact=False).first()
    assert (approx["avg"], approx["min"], approx["med"], approx["p95"], approx["max"]) == (50.5, 1, 50, 95, 100)
