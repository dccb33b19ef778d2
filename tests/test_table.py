import json
from datetime import datetime, timezone

import pytest
from helpers import entry, make_envelopes
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators import aggregate, validation
from timberline.operators.filters import LogFilter
from timberline.plans import views
from timberline.sources import storage
from timberline.sources.envelopes import read_envelopes, stream_envelopes
from timberline.sources.log_table import LogTable
from timberline.streaming.ingest import stop_after_admitted, stream_ingest
from timberline.streaming.live_counts import stream_counts

NOW = "2026-07-20T14:00:00.000Z"


def logs_at(*times, **changes):
    return {"logs": [entry(timestamp=t, attributes={"marker": f"m-{t}"}, **changes) for t in times]}


def validated(spark, *bodies):
    return validation.validate_envelopes(make_envelopes(spark, list(bodies), at=NOW))


@pytest.fixture
def table(spark, tmp_path):
    return LogTable(spark, str(tmp_path / "table")).bootstrap()


def stamps(df):
    return sorted(instants.to_wire(r[0]) for r in df.select(F.unix_millis("timestamp")).collect())


def test_append_and_read(spark, table):
    assert table.read_logs().count() == 0 and table.dates() == []
    a = table.append(validated(spark, logs_at("2026-07-19T10:00:00Z", "2026-07-20T10:00:00Z"), {"logs": [entry(level="x")]}))
    b = table.append(validated(spark, logs_at("2026-07-20T11:00:00Z")))
    assert (a, b) == (0, 1)
    assert stamps(table.read_logs()) == [
        "2026-07-19T10:00:00.000Z", "2026-07-20T10:00:00.000Z", "2026-07-20T11:00:00.000Z"
    ]
    assert [tuple(r) for r in table.rejects().select("idx", "reason").collect()] == [(0, "invalid level: 'x'")]
    assert [str(d) for d in table.dates()] == ["2026-07-19", "2026-07-20"]
    found = table.read_logs(LogFilter(attributes={"marker": "m-2026-07-20T11:00:00Z"}))
    assert stamps(found) == ["2026-07-20T11:00:00.000Z"]
    totals = table.commits().orderBy("commit_id").first()
    assert (totals["batches"], totals["failed_batches"], totals["accepted"], totals["rejected"]) == (2, 0, 2, 1)


def test_committing_again_changes_nothing(spark, table):
    rows = validated(spark, logs_at("2026-07-19T10:00:00Z", "2026-07-20T10:00:00Z"))
    table.commit(rows, 0)
    before = table.read_logs().orderBy("id").collect()
    table.commit(rows, 0)
    assert table.read_logs().orderBy("id").collect() == before
    assert table.read_rollup().agg(F.sum("n")).first()[0] == 2 and table.commits().count() == 1


def test_uncommitted_rows_are_invisible_and_discarded(spark, table):
    table.append(validated(spark, logs_at("2026-07-20T10:00:00Z")))
    left = validated(spark, logs_at("2026-07-18T10:00:00Z"))
    accepted, _ = validation.split_valid(left)
    table._overwrite(
        accepted.select(
            "id", "timestamp", "level", "service", "message", "attributes", "attr",
            F.lit(None).cast("string").alias("attr_marker"), "ingested_at",
            instants.event_date(F.col("timestamp")).alias("event_date"), F.lit(1).cast("bigint").alias("commit_id"),
        ),
        "logs", ["event_date", "commit_id"],
    )
    assert stamps(table.read_logs()) == ["2026-07-20T10:00:00.000Z"]
    assert len(table.discard_uncommitted(0)) == 1 and table.discard_uncommitted(0) == []
    assert stamps(table.read_logs()) == ["2026-07-20T10:00:00.000Z"]


def test_only_needed_dates_are_listed(spark, table):
    table.append(validated(spark, logs_at(*[f"2026-07-{d}T10:00:00Z" for d in range(10, 20)])))
    found = table.read_logs(LogFilter(since="2026-07-12T00:00:00Z", until="2026-07-13T00:00:00Z"))
    dates = {f.split("event_date=")[1][:10] for f in found.inputFiles()}
    assert dates <= {"2026-07-12", "2026-07-13"} and found.count() == 1
    assert table.read_logs(LogFilter(since="2027-01-01T00:00:00Z")).count() == 0


def test_counts_from_rollup_equal_counts_from_rows(spark, table):
    times = [f"2026-07-20T10:{m:02d}:{s:02d}.{ms:03d}Z" for m, s, ms in ((0, 0, 100), (0, 0, 900), (1, 5, 0), (59, 59, 999))]
    table.append(validated(spark, logs_at(*times)))
    table.append(validated(spark, logs_at(*times[:2], service="auth")))
    for since, until in (("10:00:00.000", "11:00:00.000"), ("10:00:00.500", "10:59:59.999"), ("10:00:00.100", "10:00:00.101")):
        f = LogFilter(since=f"2026-07-20T{since}Z", until=f"2026-07-20T{until}Z")
        assert table.count_by_bucket(f, "1m", "service").collect() == aggregate.count_by_bucket(
            table.read_logs(), f, "1m", "service"
        ).collect()


def test_newest_page_reads_back_only_as_far_as_needed(spark, table):
    times = [f"2026-07-{d:02d}T10:00:0{s}Z" for d in range(1, 20) for s in range(3)]
    table.append(validated(spark, *[logs_at(t) for t in times]))
    expected = sorted(times, reverse=True)
    seen, cursor = [], None
    while True:
        page = table.newest_page(LogFilter(), 7, cursor)
        seen += [r["attr_marker"][2:] for r in page.rows]
        if page.boundary is None:
            break
        cursor = page.boundary
    assert seen == expected
    bounded = table.newest_page(LogFilter(since="2026-07-03T00:00:00Z", until="2026-07-05T00:00:00Z"), 100)
    assert [r["attr_marker"][2:] for r in bounded.rows] == [t for t in expected if "07-03" <= t[5:10] < "07-05"]
    assert table.newest_page(LogFilter(service="none"), 5).rows == []


def test_retention(spark, table):
    cut = "2026-07-18T12:00:00.000Z"
    times = ["2026-07-16T00:00:00Z", "2026-07-18T11:59:59.999Z", cut, "2026-07-18T12:00:00.001Z", "2026-07-20T00:00:00Z"]
    table.append(validated(spark, logs_at(*times)))
    kept = ["2026-07-18T12:00:00.000Z", "2026-07-18T12:00:00.001Z", "2026-07-20T00:00:00.000Z"]
    report = table.apply_retention("2026-07-20T12:00:00.000Z", 2)
    assert report["rows_deleted"] == 2 and instants.to_wire(report["cutoff"]) == cut
    kept_report = table.retention_passes().select("rows_deleted", "duration_ms").first()
    assert tuple(kept_report) == (2, report["duration_ms"]) and table.floor() == instants.to_millis(cut)
    assert stamps(table.read_logs()) == kept
    assert [str(d) for d in table.dates()] == ["2026-07-18", "2026-07-20"]
    wide = LogFilter(since="2026-07-01T00:00:00Z", until="2026-08-01T00:00:00Z")
    assert sum(r["count"] for r in table.count_by_bucket(wide, "1d").collect()) == 3
    assert table.count_by_bucket(wide.between("2026-07-01T00:00:00Z", "2026-07-02T00:00:00Z"), "1d").count() == 0
    # A late row below the floor is stored but never seen; an earlier cutoff does not lower the floor.
    table.append(validated(spark, logs_at("2026-07-17T00:00:00Z")))
    assert stamps(table.read_logs()) == kept
    assert table.apply_retention("2026-07-20T12:00:00.000Z", 5)["rows_deleted"] == 0
    assert stamps(table.read_logs()) == kept and "2026-07-17" not in map(str, table.dates())
    assert table.read_logs(LogFilter(until="2026-07-18T00:00:00Z")).count() == 0


def write_batches(folder, bodies, first=0):
    folder.mkdir(exist_ok=True)
    for i, body in enumerate(bodies):
        (folder / f"batch-{first + i:04d}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def test_read_envelopes_by_file_and_line(spark, tmp_path):
    write_batches(tmp_path / "in", [logs_at("2026-07-19T10:00:00Z"), "{"])
    rows = read_envelopes(spark, str(tmp_path / "in"))
    assert rows.count() == 2 and rows.select("batch_id").distinct().count() == 2
    assert rows.orderBy("body").collect()[0]["batch_id"] == read_envelopes(spark, str(tmp_path / "in")).orderBy("body").first()["batch_id"]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text('{"logs":[]}\n{"logs":[1]}\n')
    assert read_envelopes(spark, str(tmp_path / "lines"), whole_files=False).count() == 2


def test_lines_of_one_file_are_judged_on_all_cores(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"logs":[],"n":{n}}}\n' for n in range(200)))
    rows = read_envelopes(spark, str(tmp_path / "a.jsonl"), whole_files=False).select("batch_id", F.spark_partition_id().alias("task")).collect()
    assert len({r["batch_id"] for r in rows}) == 200 and len({r["task"] for r in rows}) == spark.sparkContext.defaultParallelism


def test_stream_equals_batch_over_restarts(spark, table, tmp_path):
    source, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    bodies = [logs_at(f"2026-07-1{i}T10:00:00Z", "2020-01-01T00:00:00Z", "bad") for i in range(6)] + ["{", {"logs": []}]
    for part in (bodies[:3], bodies[3:]):
        write_batches(source, part, first=bodies.index(part[0]))
        stream = stream_envelopes(spark, str(source), maxFilesPerTrigger=2)
        stream_ingest(stream, table, checkpoint, drain=True).awaitTermination()
    assert stamps(table.read_logs()) == sorted(
        [f"2026-07-1{i}T10:00:00.000Z" for i in range(6)] + ["2020-01-01T00:00:00.000Z"] * 6
    )
    totals = table.commits().agg(*[F.sum(c).alias(c) for c in ("batches", "failed_batches", "accepted", "rejected")]).first()
    assert tuple(totals) == (8, 1, 12, 6)
    assert table.read_rollup().agg(F.sum("n")).first()[0] == 12
    other = str(tmp_path / "other")
    assert table.writer_base(checkpoint) != table.writer_base(other)
    stream_ingest(stream_envelopes(spark, str(source)), table, other, drain=True).awaitTermination()
    assert table.read_logs().count() == 24


def test_failed_commit_is_replayed_exactly(spark, table, tmp_path, monkeypatch):
    source, checkpoint = tmp_path / "in", str(tmp_path / "checkpoint")
    write_batches(source, [logs_at("2026-07-19T10:00:00Z", "2026-07-20T10:00:00Z")])
    original = LogTable._overwrite

    def failing(self, df, name, *rest):
        original(self, df, name, *rest)
        if name == "rollup":
            raise RuntimeError("lost")

    monkeypatch.setattr(LogTable, "_overwrite", failing)
    with pytest.raises(Exception):
        stream_ingest(stream_envelopes(spark, str(source)), table, checkpoint, drain=True).awaitTermination()
    assert table.read_logs().count() == 0 and table.rejects().count() == 0
    ids = {r["id"] for r in spark.read.parquet(f"{table.root}/logs").select("id").collect()}
    monkeypatch.setattr(LogTable, "_overwrite", original)
    stream_ingest(stream_envelopes(spark, str(source)), table, checkpoint, drain=True).awaitTermination()
    assert {r["id"] for r in table.read_logs().collect()} == ids and len(ids) == 2


def test_drain_of_a_running_stream(spark, table, tmp_path):
    source = tmp_path / "in"
    write_batches(source, [logs_at("2026-07-19T10:00:00Z")])
    query = stream_ingest(stream_envelopes(spark, str(source)), table, str(tmp_path / "c"), interval="1 second")
    write_batches(source, [logs_at("2026-07-20T10:00:00Z")], first=1)
    stop_after_admitted(query)
    assert table.read_logs().count() == 2 and not query.isActive


def test_live_counts_drop_late_rows_only_from_state(spark, tmp_path):
    source, out = tmp_path / "logs", str(tmp_path / "out")
    schema = "timestamp timestamp, service string, level string"
    parts = [["2026-07-20T10:00:00", "2026-07-20T10:59:00"], ["2026-07-20T14:00:00"], ["2026-07-20T10:30:00", "2026-07-20T13:30:00"]]
    source.mkdir()
    counts = stream_counts(spark.readStream.schema(schema).json(str(source)), "1h", "service")
    for i, part in enumerate(parts):
        (source / f"{i}.json").write_text("\n".join(
            json.dumps({"timestamp": t + "Z", "service": "s", "level": "info"}) for t in part
        ))
        counts.writeStream.outputMode("append").format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "check")
        ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert [tuple(r) for r in rows] == [("2026-07-20T10:00:00.000Z", "s", 2)]


def test_storage_lists_and_removes(spark, tmp_path):
    (tmp_path / "a=1").mkdir()
    assert storage.children(spark, str(tmp_path / "a=*")) != [] and storage.children(spark, str(tmp_path / "b=*")) == []
    storage.remove(spark, str(tmp_path / "a=1"))
    assert not storage.exists(spark, str(tmp_path / "a=1"))


def failing_at(monkeypatch, folder):
    original = LogTable._overwrite

    def failing(self, df, name, *rest):
        if name == folder:
            raise RuntimeError("lost")
        original(self, df, name, *rest)

    monkeypatch.setattr(LogTable, "_overwrite", failing)
    return lambda: monkeypatch.setattr(LogTable, "_overwrite", original)


def test_rows_of_a_failed_append_stay_hidden(spark, table, monkeypatch):
    restore = failing_at(monkeypatch, "rejects")
    with pytest.raises(RuntimeError):
        table.append(validated(spark, logs_at("2026-07-18T10:00:00Z")))
    restore()
    assert table.append(validated(spark, logs_at("2026-07-19T10:00:00Z"))) == 1
    assert stamps(table.read_logs()) == ["2026-07-19T10:00:00.000Z"]
    assert table.read_rollup().agg(F.sum("n")).first()[0] == 1
    assert len(table.discard_uncommitted(0)) == 1
    assert stamps(table.read_logs()) == ["2026-07-19T10:00:00.000Z"]


def test_a_lost_checkpoint_overwrites_nothing(spark, table, tmp_path):
    checkpoint = tmp_path / "checkpoint"
    for i, day in enumerate(("18", "19")):
        write_batches(tmp_path / f"in{i}", [logs_at(f"2026-07-{day}T10:00:00Z")])
        stream_ingest(stream_envelopes(spark, str(tmp_path / f"in{i}")), table, str(checkpoint), drain=True).awaitTermination()
        checkpoint.rename(tmp_path / f"gone{i}")
    assert stamps(table.read_logs()) == ["2026-07-18T10:00:00.000Z", "2026-07-19T10:00:00.000Z"]
    assert table.writer_base("a") == table.writer_base("a") != table.writer_base("b")


def test_identical_lines_have_ids_of_their_own_under_any_split(spark, table, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(logs_at("2026-07-19T10:00:00Z"))] * 3 + ["", "{}"]) + "\n")
    found = []
    for size in ("64b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found.append({r[0] for r in read_envelopes(spark, str(tmp_path / "a.jsonl"), whole_files=False).select("batch_id").collect()})
    assert found[0] == found[1] and len(found[0]) == 5
    table.append(validation.validate_envelopes(read_envelopes(spark, str(tmp_path / "a.jsonl"), whole_files=False)))
    seen, cursor = 0, None
    while True:
        page = table.newest_page(LogFilter(), 1, cursor)
        seen, cursor = seen + len(page.rows), page.boundary
        if cursor is None:
            break
    assert seen == 3


def test_a_whole_file_is_one_document(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"logs":\n[]}\n')
    assert [r[0] for r in read_envelopes(spark, str(tmp_path)).select("body").collect()] == ['{\n"logs":\n[]}\n']


def test_object_stores_are_refused(spark):
    for root in ("s3a://bucket/logs", "S3://bucket"):
        with pytest.raises(ValueError, match="one caller"):
            LogTable(spark, root)
    LogTable(spark, "s3a")
