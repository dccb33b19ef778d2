"""Nested cells, covers, answers to tables of requests, boundaries bound to their filter, and boards."""

import random

import pytest
from helpers import entry, make_envelopes, make_logs, plan_text
from pyspark.sql import functions as F

from timberline import session
from timberline.functions import instants
from timberline.operators import aggregate, paging, requests, tiers, validation
from timberline.operators.filters import LogFilter
from timberline.plans import dashboard
from timberline.schema import BUCKET_MS, STORED_LOGS
from timberline.sources import storage
from timberline.sources.log_table import LogTable

DAY = 86_400_000
BASE = instants.to_millis("2026-07-30T00:00:00Z")


def test_covers_are_exact_and_shortest():
    draw = random.Random(4)
    for _ in range(3000):
        lo = BASE + draw.randrange(3 * DAY)
        hi = lo + draw.choice([0, 1, 999, 61_000, draw.randrange(3 * DAY)])
        if draw.random() < 0.5:
            lo, hi = lo // 60_000 * 60_000, max(hi, lo) // 60_000 * 60_000
        widest = draw.choice(list(BUCKET_MS.values()))
        c = tiers.cover(lo, hi, widest, dict.fromkeys(tiers.TIERS))
        parts, at = sorted([(a, b) for _, a, b in c.pieces] + list(c.rows)), lo
        for a, b in parts:
            assert a == at < b
            at = b
        assert at == max(lo, hi)
        assert len(c.rows) <= 2 and all(b - a < 1000 for a, b in c.rows)
        counts = {t: sum((b - a) // (t * 1000) for tier, a, b in c.pieces if tier == t) for t in tiers.TIERS}
        usable = [t for t in tiers.TIERS if widest % (t * 1000) == 0]
        # A finer tier fills less than one wider cell at each end.
        assert all(counts[fine] < 2 * wide // fine for fine, wide in zip(usable, usable[1:]))


def test_evicted_tiers_leave_rows():
    covered = tiers.coverage(BASE + DAY, {1: 3_600_000, 60: DAY // 2, 3_600: None})
    c = tiers.cover(BASE + 1, BASE + DAY, 3_600_000, covered)
    assert c.rows == ((BASE + 1, BASE + 3_600_000),) and c.pieces == ((3_600, BASE + 3_600_000, BASE + DAY),)
    # Minutes alone would start at noon; what is before comes from the rows.
    late = tiers.cover(BASE, BASE + DAY, 60_000, covered)
    assert late.rows == ((BASE, BASE + DAY // 2),) and late.pieces == ((60, BASE + DAY // 2, BASE + DAY),)


@pytest.fixture(scope="module")
def drawn(spark):
    """Rows at awkward instants: month and day ends, equal instants, before 1970, several services."""
    draw = random.Random(8)
    at = [BASE + draw.randrange(4 * DAY) for _ in range(250)] + [BASE + 2 * DAY - 1, BASE + 2 * DAY, BASE + 2 * DAY] + [-1, 0, -86_400_000]
    rows = [(n, t, draw.choice(["info", "error"]), draw.choice(["a", "b", None]), "m", {}) for n, t in enumerate(at)]
    logs = make_logs(spark, rows).cache()
    return logs, tiers.cells_of(logs).cache()


def test_tiers_agree_with_rows_on_random_ranges(drawn):
    logs, cells = drawn
    draw = random.Random(9)
    totals = {r["tier"]: r["n"] for r in cells.groupBy("tier").agg(F.sum("n").alias("n")).collect()}
    assert totals == dict.fromkeys(tiers.TIERS, logs.count())
    for bucket in BUCKET_MS:
        lo = BASE + draw.randrange(2 * DAY)
        hi = lo + draw.choice([500, 60_000, DAY, 2 * DAY + 1])
        for f, group in ((LogFilter(since=lo, until=hi), None), (LogFilter("a", None, -2 * DAY, hi), "level")):
            expected = aggregate.count_by_bucket(logs, f, bucket, group).collect()
            assert tiers.aggregate_with_tiers(logs, cells, f, bucket, group).collect() == expected
            covered = tiers.coverage(BASE + 3 * DAY)
            kept = tiers.evict_tiers(cells, BASE + 3 * DAY)
            assert tiers.aggregate_with_tiers(logs, kept, f, bucket, group, covered).collect() == expected
    searched = LogFilter(since=BASE, until=BASE + DAY, q="M")
    assert tiers.aggregate_with_tiers(logs, cells.limit(0), searched, "1h").collect() == aggregate.count_by_bucket(logs, searched, "1h").collect()
    with pytest.raises(ValueError):
        tiers.aggregate_with_tiers(logs, cells, LogFilter(since=BASE), "1h")


def filled(spark, path, *batches):
    table = LogTable(spark, str(path)).bootstrap()
    for batch in batches:
        body = {"logs": [entry(timestamp=t, service=s, level=v) for t, s, v in batch]}
        table.append(validation.validate_envelopes(make_envelopes(spark, [body])))
    return table


def test_stored_tiers_take_late_rows_and_read_few_folders(spark, tmp_path):
    early = [("2026-05-30T10:00:00.500Z", "a", "info"), ("2026-06-02T10:00:00Z", "a", "error"), ("2026-06-30T23:59:59.999Z", "b", "info")]
    late = [("2026-06-02T10:00:00.100Z", "a", "info"), ("2025-12-31T23:59:59Z", "a", "info")]
    table = filled(spark, tmp_path / "t", early, late)
    wide = LogFilter(since="2025-01-01T00:00:00Z", until="2026-07-01T00:00:00Z")
    assert [(r["start"][:10], r["count"]) for r in table.count_by_bucket(wide, "1d").collect()] == [
        ("2025-12-31", 1), ("2026-05-30", 1), ("2026-06-02", 2), ("2026-06-30", 1)]
    month = LogFilter(since="2026-06-01T00:00:00Z", until="2026-07-01T00:00:00Z")
    hours = table.count_by_bucket(month, "1h", "level")
    assert {f.split("/rollup/")[1].split("/commit_id")[0] for f in hours.inputFiles()} == {"tier=3600/period=2026-06-01"}
    edge = month.between("2026-05-30T10:00:00.400Z", "2026-06-30T23:59:59.999Z")
    read = {f.split(f"{tmp_path}/t/")[1].split("/commit_id")[0] for f in table.count_by_bucket(edge, "1d").inputFiles()}
    assert "logs/event_date=2026-05-30" in read and "logs/event_date=2026-06-02" not in read
    for f in (wide, month, edge):
        assert table.count_by_bucket(f, "1h", "service").collect() == aggregate.count_by_bucket(table.read_logs(), f, "1h", "service").collect()
    table.apply_retention("2026-07-02T10:00:00.050Z", 30)
    assert table.count_by_bucket(wide, "1h").collect() == aggregate.count_by_bucket(table.read_logs(), wide, "1h").collect()
    assert sum(r["count"] for r in table.count_by_bucket(wide, "1d").collect()) == 2
    assert storage.children(spark, f"{tmp_path}/t/rollup/tier=60/period=2026-05-01") == []
    assert storage.children(spark, f"{tmp_path}/t/rollup/tier=86400/period=2025-01-01") == []


REQUESTS = "request_id string, service string, level string, since_ms bigint, until_ms bigint, bucket string, group_by string"


def test_requests_agree_with_each_alone(spark, drawn):
    logs, cells = drawn
    draw = random.Random(10)
    asked = []
    for i in range(12):
        lo = BASE + draw.randrange(3 * DAY)
        bucket = list(BUCKET_MS)[i % 4]
        hi = lo + (draw.randrange(2 * 3_600_000) if bucket == "1m" else draw.randrange(2 * DAY))
        asked.append((f"r{i}", draw.choice(["a", "b", "none", None]), draw.choice(["info", None]), lo, hi, bucket, [None, "service", "level"][i % 3]))
    asked += [("edge", None, None, BASE + 2 * DAY - 1, BASE + 2 * DAY, "1m", "level"), ("empty", "a", None, BASE, BASE, "1h", None),
              ("bad", None, None, None, None, None, None), ("old", None, None, -2 * DAY, 1, "1d", "service"), ("r0", *asked[0][1:])]
    found = requests.answer_requests(spark.createDataFrame(asked, REQUESTS), logs, cells)
    got = {}
    for r in found.collect():
        got.setdefault(r["request_id"], []).append((r["start"], r["group"], r["count"]))
    for name, service, level, lo, hi, bucket, group in asked[:-1]:
        expected = []
        if bucket and hi > lo:
            f = LogFilter(service, level, lo, hi)
            seen = logs if group != "service" else logs.where("service IS NOT NULL")
            expected = [tuple(r) for r in aggregate.count_by_bucket(seen, f, bucket, group).collect()]
        times = 2 if name == "r0" else 1
        assert sorted(map(repr, got.get(name, []))) == sorted(map(repr, expected * times)), name
    none = spark.createDataFrame([], REQUESTS)
    assert requests.answer_requests(none, logs, cells).count() == 0


def test_buckets_of_requests_are_not_shuffled(spark, drawn):
    """A request's buckets are made behind the last shuffle, so that disk grows with the requests and not with their buckets."""
    logs, cells = drawn
    asked = spark.createDataFrame([("r", None, None, BASE + 1, BASE + 3 * DAY - 1, "1m", "service")], REQUESTS)
    plan = plan_text(requests.answer_requests(asked, logs, cells), "simple")
    assert plan.index("Generate explode") < plan.index("Exchange")


def test_boundaries_belong_to_their_filter(spark, tmp_path):
    logs = make_logs(spark, [(n, BASE + n // 2, "info", "s", "m", {"k": "1"}) for n in range(9)]).cache()
    f = LogFilter("s", attributes={"k": "1"})
    first = paging.page(logs, f, 4)
    second = paging.page(logs, LogFilter("s", attributes={"k": "1"}), 3, first.boundary)
    assert [r["id"][-1] for r in first.rows + second.rows] == list("8765432")
    column = paging.filter_fingerprint(*[F.lit(x).cast("string") for x in ("s", None, None, None, None)], F.create_map(F.lit("k"), F.lit("1")))
    assert first.boundary.fingerprint == spark.range(1).select(column).first()[0]
    for other in (LogFilter("t", attributes={"k": "1"}), LogFilter("s"), LogFilter("s", since=BASE, attributes={"k": "1"})):
        with pytest.raises(ValueError, match="invalid cursor"):
            paging.page(logs, other, 4, first.boundary)
        with pytest.raises(ValueError, match="invalid cursor"):
            paging.page_rows(logs, other, 4, first.boundary)
    for broken in (first.boundary._replace(v=2), first.boundary._replace(id="x"), first.boundary._replace(fingerprint="beef")):
        with pytest.raises(ValueError, match="invalid cursor"):
            paging.page(logs, f, 4, broken)
    table = filled(spark, tmp_path / "t", [("2026-06-02T10:00:00Z", "a", "info"), ("2026-06-03T10:00:00Z", "a", "error")])
    page = table.newest_page(LogFilter("a"), 1)
    with pytest.raises(ValueError, match="invalid cursor"):
        table.newest_page(LogFilter("b"), 1, page.boundary)
    assert table.newest_page(LogFilter("a"), 1, page.boundary).boundary is None


def test_boards_from_cells_and_their_pages(spark, tmp_path, drawn):
    logs, cells = drawn
    now = BASE + 3 * DAY + 777
    for group in ("level", "service"):
        plain = dashboard.dashboard_report(logs, LogFilter(), now, "24h", group)
        quick = dashboard.dashboard_report(logs, LogFilter(), now, "24h", group, cells=cells)
        assert sorted(map(repr, dashboard.as_rows(quick).collect())) == sorted(map(repr, dashboard.as_rows(plain).collect()))
    assert quick.filter.until == now
    table = filled(spark, tmp_path / "t", [(f"2026-07-0{d}T10:00:0{s}Z", "a", "info") for d in (1, 2, 3) for s in range(3)])
    board = dashboard.table_report(table, LogFilter(service=" a "), "2026-07-03T10:00:02.500Z", "7d", limit=4)
    assert board.metrics.first()["total"] == 9 and board.latest.count() == 4
    table.append(validation.validate_envelopes(make_envelopes(spark, [{"logs": [entry(timestamp="2026-07-03T10:00:03Z", service="a")]}])))
    seen, cursor = [], None
    while True:
        page = board.page(cursor)
        seen += [instants.to_wire(r["timestamp_ms"]) for r in page.rows]
        cursor = page.boundary
        if cursor is None:
            break
    assert len(seen) == 9 and seen == sorted(seen, reverse=True) and seen[0] == "2026-07-03T10:00:02.000Z"
    with pytest.raises(ValueError, match="invalid cursor"):
        dashboard.table_report(table, LogFilter(service="a"), "2026-07-03T10:00:05Z", "7d", limit=4).page(board.page().boundary)
    searched = dashboard.table_report(table, LogFilter(q="OK"), "2026-07-03T10:00:05Z", "7d")
    assert searched.metrics.first()["total"] == 10


def test_scratch_folders_can_be_discarded(spark):
    kept = session.materialise(spark.range(3), "kept")
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert storage.exists(spark, path) and session.discard_scratch(spark) >= 1
    assert not storage.exists(spark, path) and session.discard_scratch(spark) == 0


def test_cells_are_read_once_and_pruned(spark, drawn, tmp_path):
    _, cells = drawn
    cells.write.partitionBy("tier").parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    c = tiers.cover(BASE + 60_000, BASE + DAY, 3_600_000, dict.fromkeys(tiers.TIERS))
    plan = plan_text(tiers.count_by_key(spark.createDataFrame([], STORED_LOGS), stored, LogFilter(), c, "1h"))
    assert plan.count("Scan parquet") == 2 and plan.count("Exchange (") == 1 and "PartitionFilters: [((tier" in plan and "PushedFilters: [Or(" in plan


def test_a_marker_is_found_without_reading_the_table(spark, tmp_path):
    """Row groups whose marker statistics or bloom filter lack the value are skipped."""
    times = [f"2026-06-{d:02d}T10:{m:02d}:00Z" for d in range(1, 11) for m in range(20)]
    body = {"logs": [entry(timestamp=t, attributes={"marker": f"m{i * 7919 % 200}"}) for i, t in enumerate(times)]}
    table = LogTable(spark, str(tmp_path / "t")).bootstrap()
    table.append(validation.validate_envelopes(make_envelopes(spark, [body])))
    found = table.read_logs(LogFilter(attributes={"marker": "m17"})).select("timestamp", "attr_marker")
    plan = found._jdf.queryExecution().executedPlan()
    assert len(found.collect()) == 1 and "EqualTo(attr_marker,m17)" in plan_text(found)
    found._jdf.collectToPython()
    read = plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert 0 < read <= 2 * 20
