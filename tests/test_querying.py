from datetime import datetime, timezone

import pytest
from helpers import make_logs, plan_text
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators import aggregate, paging, rollup
from timberline.operators import filters as P
from timberline.operators.filters import LogFilter
from timberline.operators.numbering import exact_quantiles

T0 = "2026-07-20T14:00:00.000Z"
RELAXED = settings(
    max_examples=12, deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)


@pytest.fixture(scope="module")
def scenario(spark):
    return make_logs(spark, [
        (0, T0, "info", "checkout", "100%_Ready", {"retries": "3", "enabled": "true"}),
        (2, T0, "error", "checkout", "100%_Ready second", {"retries": "3", "enabled": "false"}),
        (3, "2026-07-20T13:59:00.000Z", "info", "auth", "ordinary log", {"retries": "false", "a.b": "x"}),
    ]).cache()


def numbers(df):
    return sorted(int(r["id"][-12:], 16) for r in df.collect())


@pytest.mark.parametrize("f, expected", [
    (LogFilter(), [0, 2, 3]),
    (LogFilter(service="checkout", q="100%_ready", attributes={"retries": "3"}), [0, 2]),
    (LogFilter(service="Checkout"), []),
    (LogFilter(service=""), []),
    (LogFilter(q=""), [0, 2, 3]),
    (LogFilter(q="100__ready"), []),
    (LogFilter(q="SECOND"), [2]),
    (LogFilter(level="error"), [2]),
    (LogFilter(since=T0), [0, 2]),
    (LogFilter(until=T0), [3]),
    (LogFilter(since=T0, until=T0), []),
    (LogFilter(attributes={"retries": "3", "enabled": "false"}), [2]),
    (LogFilter(attributes={"a.b": "x"}), [3]),
    (LogFilter(attributes={"missing": ""}), []),
])
def test_filters(scenario, f, expected):
    assert numbers(P.apply_filters(scenario, f)) == expected


def test_literal_wildcards(spark):
    logs = make_logs(spark, [
        (1, T0, "info", "s", r"at 50%_DONE\ok now", {}), (2, T0, "info", "s", r"at 50x_done\ok", {}),
        (3, T0, "info", "s", "50%-done\\ok", {}),
    ])
    assert numbers(P.apply_filters(logs, LogFilter(q=r"50%_done\ok"))) == [1]


def test_invalid_filters():
    for kw in ({"level": "critical"}, {"since": T0, "until": "2026-07-20T13:59:59.999Z"}, {"attributes": {"": "x"}},
               {"attributes": {"k" * 257: "x"}}):
        with pytest.raises(ValueError):
            LogFilter(**kw)
    LogFilter(attributes={"k" * 256: "x"})


def test_predicates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(
        F.timestamp_millis(F.col("id") * 1000).alias("timestamp"), F.lit("s").alias("service"),
        F.lit("info").alias("level"), F.col("id").cast("string").alias("id"),
    ).write.parquet(path)
    logs = spark.read.parquet(path)
    found = P.apply_filters(logs, LogFilter("s", "info", 0, 50_000)).where(P.before_cursor(40_000, "5"))
    plan = plan_text(found)
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    for text in ("EqualTo(service,s)", "EqualTo(level,info)", "GreaterThanOrEqual(timestamp", "LessThan(timestamp", "Or("):
        assert text in pushed


def walk(logs, f, limit):
    pages, cursor = [], None
    while True:
        found = paging.page(logs, f, limit, cursor)
        pages.append([(r["timestamp_ms"], r["id"]) for r in found.rows])
        if found.boundary is None:
            return pages
        cursor = found.boundary


def test_pages_of_one_service(scenario):
    pages = walk(scenario, LogFilter(service="checkout"), 1)
    assert [len(p) for p in pages] == [1, 1] and pages[0] != pages[1]


def test_cursor_orders_ids_of_one_instant(scenario):
    at = scenario.where(P.before_cursor(T0, "00000000-0000-7000-8000-000000000002".upper()))
    assert numbers(at) == [0, 3]


@RELAXED
@given(st.lists(st.integers(0, 5), min_size=0, max_size=40), st.integers(1, 9))
def test_pages_cover_everything_once(spark, ticks, limit):
    logs = make_logs(spark, [(n, t * 1000, "info", "s", "m", {}) for n, t in enumerate(ticks)]).cache()
    everything = sorted(((t * 1000, f"00000000-0000-7000-8000-{n:012x}") for n, t in enumerate(ticks)), reverse=True)
    pages = walk(logs, LogFilter(), limit)
    assert [row for p in pages for row in p] == everything
    table = paging.page_table(logs, limit, partitions=3).orderBy("page_no").collect()
    assert [r["page_no"] for r in table] == list(range(1, -(-len(ticks) // limit) + 1))
    assert [(instants.to_millis(r["boundary_ts"].replace(tzinfo=timezone.utc)), r["boundary_id"]) for r in table] == [
        p[-1] for p in pages if p
    ]
    logs.unpersist()


def test_page_limit_bounds(scenario):
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            paging.page(scenario, LogFilter(), limit)


def test_merge_pages_drops_repeated_ids(spark):
    rows = [(n, T0, "info", "s", "m", {}) for n in range(4)]
    held, older = make_logs(spark, rows[:2]), make_logs(spark, rows[1:] + rows[3:])
    assert numbers(paging.merge_pages(held, older)) == [0, 1, 2, 3]


def test_fingerprint_ignores_key_order_and_limit(spark):
    df = spark.createDataFrame(
        [({"b": "2", "a": "1"}, "s"), ({"a": "1", "b": "2"}, "s"), ({"a": "1"}, "s"), (None, None)],
        "attr map<string,string>, service string",
    )
    null = F.lit(None).cast("string")
    prints = [r[0] for r in df.select(
        paging.filter_fingerprint(F.col("service"), null, null, null, null, F.col("attr"))
    ).collect()]
    assert prints[0] == prints[1] and len(set(prints)) == 3


def test_count_by_bucket_golden(scenario):
    f = LogFilter(since=T0, until="2026-07-20T14:01:00Z")
    rows = aggregate.count_by_bucket(scenario, f, "1m", "service").collect()
    assert [tuple(r) for r in rows] == [("2026-07-20T14:00:00.000Z", "checkout", 2)]


@pytest.mark.parametrize("bucket", ["1m", "5m", "1h", "1d"])
@pytest.mark.parametrize("group", [None, "service", "level"])
def test_every_bucket_and_group_in_any_zone(scenario, zones, bucket, group):
    f = LogFilter(since="2026-07-20T00:00:00Z", until="2026-07-21T00:00:00Z")
    size = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}[bucket]
    expected = {}
    for at, level, service in (
        ("2026-07-20T14:00:00", "info", "checkout"), ("2026-07-20T14:00:00", "error", "checkout"),
        ("2026-07-20T13:59:00", "info", "auth"),
    ):
        second = int(datetime.fromisoformat(at + "+00:00").timestamp()) // size * size
        key = (instants.to_wire(second * 1000), {"service": service, "level": level}.get(group))
        expected[key] = expected.get(key, 0) + 1

    def check():
        rows = aggregate.count_by_bucket(scenario, f, bucket, group).collect()
        assert [tuple(r) for r in rows] == [(*k, n) for k, n in sorted(expected.items(), key=lambda i: (i[0][0], i[0][1] or ""))]

    zones(check)


def test_counting_needs_both_bounds(scenario):
    for f in (LogFilter(), LogFilter(since=T0), LogFilter(until=T0)):
        with pytest.raises(ValueError, match="since and until are required"):
            aggregate.count_by_bucket(scenario, f, "1m")
    with pytest.raises(ValueError, match="bucket must be one of"):
        aggregate.count_by_bucket(scenario, LogFilter(since=T0, until=T0), "2m")
    with pytest.raises(ValueError, match="group_by"):
        aggregate.count_by_bucket(scenario, LogFilter(since=T0, until=T0), "1m", "message")


def test_safe_count(spark):
    top = 9_007_199_254_740_991
    df = spark.createDataFrame([(0, None, top)], "start_ms bigint, `group` string, count bigint")
    assert aggregate.present(df).first()["count"] == top
    with pytest.raises(Exception, match="safe integer range"):
        aggregate.present(df.withColumn("count", F.col("count") + 1)).collect()


def test_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "start string, `group` string, count bigint")
    assert tuple(aggregate.totals(empty).first()) == (0, 0)
    assert aggregate.error_share(empty).first()[0] is None


ROLLUP_ROWS = [
    (1, "2026-08-12T19:59:01.100Z", "info", "api", "m", {}), (2, "2026-08-12T19:59:01.900Z", "info", "api", "m", {}),
    (3, "2026-08-12T19:59:02.100Z", "error", "checkout", "m", {}),
]
COVERED = "2026-08-12T18:00:00Z"


def test_route_golden():
    f = LogFilter(since="2026-08-12T19:59:01Z", until="2026-08-12T19:59:03Z")
    assert rollup.route(f, COVERED).fringes == ()
    r = rollup.route(LogFilter(since="2026-08-12T19:59:01.250Z", until="2026-08-12T19:59:02.750Z"), COVERED)
    ms = instants.to_millis("2026-08-12T19:59:02Z")
    assert r.fringes == ((ms - 750, ms), (ms, ms + 750)) and r.full_since == r.full_until == ms
    assert rollup.route(f.between("2026-08-12T17:59:59.999Z", COVERED), COVERED) is None
    assert rollup.route(f.between("2026-08-12T19:59:01.250Z", "2026-08-12T19:59:01.750Z"), COVERED) is None
    assert rollup.route(LogFilter(since=f.since, until=f.until, attributes={"a": "b"}), COVERED) is None
    assert rollup.route(LogFilter(since=f.since, until=f.until, q=""), COVERED) is None
    assert rollup.route(f, COVERED, enabled=False) is None


def test_rollup_golden(spark):
    logs = make_logs(spark, ROLLUP_ROWS)
    cells = rollup.rollup_1s(logs)
    full = LogFilter(since="2026-08-12T19:59:01Z", until="2026-08-12T19:59:03Z")
    found = rollup.aggregate_with_rollup(logs.limit(0), cells, full, "1m", "service", COVERED).collect()
    assert [(r["group"], r["count"]) for r in found] == [("api", 2), ("checkout", 1)]
    edge = full.between("2026-08-12T19:59:01.250Z", "2026-08-12T19:59:02.750Z")
    found = rollup.aggregate_with_rollup(logs, cells, edge, "1m", "service", COVERED).collect()
    assert [(r["group"], r["count"]) for r in found] == [("api", 1), ("checkout", 1)]


@RELAXED
@given(st.data())
def test_both_routes_agree(spark, data):
    base = instants.to_millis("2026-08-12T19:58:57Z")
    rows = data.draw(st.lists(
        st.tuples(st.integers(0, 8_000), st.sampled_from(["info", "error"]), st.sampled_from(["a", "b"])), max_size=25
    ))
    lo = data.draw(st.integers(0, 8_000))
    hi = data.draw(st.integers(lo, 8_500))
    group = data.draw(st.sampled_from([None, "service", "level"]))
    service = data.draw(st.sampled_from([None, "a"]))
    logs = make_logs(spark, [(n, base + t, lv, sv, "m", {}) for n, (t, lv, sv) in enumerate(rows)])
    f = LogFilter(service=service, since=base + lo, until=base + hi)
    direct = aggregate.count_by_bucket(logs, f, "1m", group).collect()
    routed = rollup.aggregate_with_rollup(logs, rollup.rollup_1s(logs), f, "1m", group, base).collect()
    assert direct == routed


@RELAXED
@given(st.lists(st.integers(0, 20), min_size=1, max_size=60))
def test_exact_quantiles(spark, values):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    probabilities = {"lo": 0.0, "med": 0.5, "p90": 0.9, "p99": 0.99, "hi": 1.0}
    row = exact_quantiles(df, "v", probabilities).first().asDict()
    assert row == pytest.approx({n: float(np.quantile(values, p)) for n, p in probabilities.items()})
