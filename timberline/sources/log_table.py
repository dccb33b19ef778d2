"""The stored log table: date-partitioned Parquet, idempotent commits and a retention floor.

Layout under one root folder::

    logs/event_date=D/commit_id=N        accepted rows
    rollup/tier=T/period=D/commit_id=N   counts of the same rows per second, minute, hour and day
    rejects/commit_id=N                  refused entries
    commits/commit_id=N                  written last: readers see commit N only once this exists
    floors/cutoff=MS                     retention cutoffs; the highest one hides everything older
    retention/                           what each retention pass did
    writers/writer-W                     the stream that owns the numbers of writer W
    claims/N                             a direct append that is under way, or has failed

Writing commit N again replaces exactly its own folders. Numbers of one stream ascend and are written
one after the other. A number claimed by a direct append is never given out again, so rows of a failed one
stay hidden. The committed set is one range per writer, cut at the claims that have no commit record.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, replace
from datetime import date, datetime, timezone
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline import schema
from timberline.functions import instants
from timberline.operators import filters as P
from timberline.operators import aggregate, retention, tiers
from timberline.operators.paging import Boundary, Page, checked_key, read_page
from timberline.operators.validation import split_valid, stored_bytes
from timberline.sources import storage

# Commit numbers of one writer: its number in the upper bits, its own sequence in the lower.
_WRITER_BITS = 32
_DIRECT_WRITER = 0


@dataclass(frozen=True)
class Snapshot:
    """What a reader may see: the retention floor and the committed numbers of every writer."""

    floor: int | None
    ranges: tuple[tuple[int, int], ...]

    def committed(self) -> Column:
        condition = F.lit(False)
        for first, last in self.ranges:
            condition = condition | F.col("commit_id").between(first, last)
        return condition

    def above_floor(self, f: P.LogFilter) -> P.LogFilter | None:
        """The filter with its lower bound raised to the floor; None when nothing is left."""
        if self.floor is None or (f.since is not None and instants.to_millis(f.since) >= self.floor):
            return f
        if f.until is not None and instants.to_millis(f.until) <= self.floor:
            return None
        return replace(f, since=self.floor)


# Stores in which two callers may both create the same file.
_NO_EXCLUSIVE_CREATE = ("s3", "s3a", "s3n")


class LogTable:
    def __init__(self, spark: SparkSession, root: str):
        if root.split("://", 1)[0].lower() in _NO_EXCLUSIVE_CREATE and "://" in root:
            raise ValueError("the table needs a file system that lets only one caller create a file")
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def bootstrap(self) -> LogTable:
        """Create the empty datasets that do not exist yet."""
        for name, fields in (
            ("logs", schema.STORED_LOGS), ("rollup", schema.STORED_ROLLUP),
            ("rejects", schema.STORED_REJECTS), ("commits", schema.STORED_COMMITS),
            ("retention", schema.STORED_RETENTION),
        ):
            if not storage.exists(self.spark, self._path(name)):
                self.spark.createDataFrame([], fields).write.parquet(self._path(name))
        return self

    # -- commit state -------------------------------------------------------------------------

    def commits(self) -> DataFrame:
        """Totals per commit, one row each."""
        return self.spark.read.schema(schema.STORED_COMMITS).parquet(self._path("commits"))

    def _committed_ranges(self) -> list[tuple[int, int]]:
        """First and last number of every committed range.

        Commit records are read before claims: a number below the last one that has no record by then was
        claimed earlier, and its claim stays until the record is there.
        """
        last: dict[int, int] = {}
        for number in self._recorded():
            last[number >> _WRITER_BITS] = max(number, last.get(number >> _WRITER_BITS, number))
        found, claimed = [], self._open_claims()
        for writer, newest in sorted(last.items()):
            first = writer << _WRITER_BITS
            for gap in [n for n in claimed if first <= n <= newest]:
                if first < gap:
                    found.append((first, gap - 1))
                first = gap + 1
            if first <= newest:
                found.append((first, newest))
        return found

    def _recorded(self) -> list[int]:
        """Commit numbers by the names of their records: one listing instead of a job."""
        return [int(p.rsplit("=", 1)[1]) for p in storage.children(self.spark, self._path("commits/commit_id=*"))]

    def _last(self, base: int) -> int:
        """Last committed number of one writer; ``base - 1`` if there is none."""
        return max((n for n in self._recorded() if base <= n < base + (1 << _WRITER_BITS)), default=base - 1)

    def _claims(self) -> list[int]:
        return sorted(int(p.rsplit("/", 1)[1]) for p in storage.children(self.spark, self._path("claims/*")))

    def _open_claims(self) -> list[int]:
        """Numbers of direct appends that have no commit record (yet)."""
        return [n for n in self._claims() if not self._has_record(n)]

    def _has_record(self, commit_id: int) -> bool:
        return storage.exists(self.spark, self._path(f"commits/commit_id={commit_id}"))

    def snapshot(self) -> Snapshot:
        """The state all parts of one answer are read at."""
        return Snapshot(self.floor(), tuple(self._committed_ranges()))

    def floor(self) -> int | None:
        """Highest retention cutoff applied so far, in epoch milliseconds."""
        return max((int(p.rsplit("=", 1)[1]) for p in storage.children(self.spark, self._path("floors/cutoff=*"))), default=None)

    def writer_base(self, owner: str) -> int:
        """First commit number of the stream ``owner``; the same for every later start.

        The writer number comes from the owner's name, and a file that only one caller can create keeps it, so
        streams that start together never share one.
        """
        writer = 1 + int.from_bytes(hashlib.sha256(owner.encode()).digest()[:4]) % ((1 << 31) - 2)
        while True:
            path = self._path(f"writers/writer-{writer}")
            if storage.create_new(self.spark, path, owner) or storage.read_text(self.spark, path) == owner:
                return writer << _WRITER_BITS
            writer = writer % ((1 << 31) - 2) + 1

    def discard_uncommitted(self, base: int) -> list[str]:
        """Drop what failed commits of one writer left; for direct appends only while none is under way."""
        numbers = {self._last(base) + 1}
        if base == _DIRECT_WRITER << _WRITER_BITS:
            numbers.update(self._open_claims())
        stale = [
            path for number in sorted(numbers) for name in ("logs/event_date=*/", "rollup/tier=*/period=*/", "rejects/")
            for path in storage.children(self.spark, self._path(f"{name}commit_id={number}"))
        ]
        for path in stale:
            storage.remove(self.spark, path)
        return stale

    # -- writing ------------------------------------------------------------------------------

    def append(self, validated: DataFrame) -> int:
        """Commit validated entries outside a stream, under a number no other attempt has had."""
        base = _DIRECT_WRITER << _WRITER_BITS
        while True:
            commit_id = max([*self._claims(), self._last(base)]) + 1
            claim = self._path(f"claims/{commit_id}")
            if storage.create_new(self.spark, claim):
                if not self._has_record(commit_id):
                    break
                storage.remove(self.spark, claim)
        self.commit(validated, commit_id)
        storage.remove(self.spark, claim)
        return commit_id

    def commit(self, validated: DataFrame, commit_id: int) -> None:
        """Write rows, refusals, counts and finally the commit record.

        ``validated`` must give the same rows when evaluated again: it is kept in memory for the four
        writes, and recomputed from its source where an executor was lost.
        """
        kept = validated.persist()
        try:
            accepted, rejected = split_valid(kept)
            stored = accepted.select(
                *schema.LOG_COLUMNS,
                F.try_element_at("attr", F.lit("marker")).alias("attr_marker"),
                "ingested_at",
                instants.event_date(F.col("timestamp")).alias("event_date"),
                F.lit(commit_id).cast("bigint").alias("commit_id"),
            )
            # Rebalancing by date gives few files per date and splits a date that is too big for one.
            self._overwrite(
                stored.hint("rebalance", "event_date"), "logs", ["event_date", "commit_id"],
                {"parquet.bloom.filter.enabled#attr_marker": "true"},
            )
            self._overwrite(
                rejected.withColumn("commit_id", F.lit(commit_id).cast("bigint")), "rejects", ["commit_id"]
            )
            # Few files per period, each in the order that ranges are asked in.
            cells = tiers.cells_of(accepted).select(
                "start", "service", "level", "n", "tier", tiers.period_of(F.col("tier"), F.col("start")).alias("period"),
                F.lit(commit_id).cast("bigint").alias("commit_id"),
            ).hint("rebalance", "tier", "period").sortWithinPartitions("tier", "period", "start")
            self._overwrite(cells, "rollup", ["tier", "period", "commit_id"])
            self._overwrite(self._totals(kept, commit_id), "commits", ["commit_id"])
        finally:
            kept.unpersist()

    @staticmethod
    def _totals(validated: DataFrame, commit_id: int) -> DataFrame:
        kept = F.col("id").isNotNull()
        # Every batch has either its first entry or one row without an entry.
        batch = F.col("idx").isNull() | (F.col("idx") == 0)
        return validated.agg(
            F.count_if(batch).alias("batches"),
            F.count_if(F.col("envelope_error").isNotNull()).alias("failed_batches"),
            F.count_if(kept).alias("accepted"),
            F.count_if(F.col("reason").isNotNull()).alias("rejected"),
            F.coalesce(F.sum(F.when(kept, stored_bytes())), F.lit(0)).alias("normalized_bytes"),
        ).select(
            "*", F.current_timestamp().alias("committed_at"), F.lit(commit_id).cast("bigint").alias("commit_id")
        )

    def _overwrite(self, df: DataFrame, name: str, partitions: list[str], options: dict | None = None) -> None:
        (
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**(options or {}))
            .partitionBy(*partitions).parquet(self._path(name))
        )

    # -- reading ------------------------------------------------------------------------------

    def dates(self) -> list[date]:
        """Dates that have rows, oldest first."""
        found = storage.children(self.spark, self._path("logs/event_date=*"))
        return [date.fromisoformat(p.rsplit("=", 1)[1]) for p in found]

    def _scan(self, name: str, fields: T.StructType, folders: list[str] | None, at: Snapshot) -> DataFrame:
        """Committed rows; only the given folders are listed, all of them if None."""
        base = self._path(name)
        reader = self.spark.read.schema(fields).option("basePath", base)
        if folders is not None and not folders:
            return self.spark.createDataFrame([], fields)
        found = reader.parquet(base) if folders is None else reader.parquet(*[f"{base}/{folder}" for folder in folders])
        return found.where(at.committed())

    def _dates_within(self, ranges) -> list[str]:
        """Folders of the dates that half-open ranges touch."""
        days = [(instants.to_date(lo), instants.to_date(hi - 1)) for lo, hi in ranges]
        return [f"event_date={d}" for d in self.dates() if any(lo <= d <= hi for lo, hi in days)]

    def _scan_logs(self, f: P.LogFilter, at: Snapshot) -> DataFrame:
        if f.since is None and f.until is None:
            return self._scan("logs", schema.STORED_LOGS, None, at)
        lo = instants.to_date(f.since) if f.since is not None else date.min
        hi = instants.to_date(f.until) if f.until is not None else date.max
        return self._scan("logs", schema.STORED_LOGS, [f"event_date={d}" for d in self.dates() if lo <= d <= hi], at)

    def read_logs(self, f: P.LogFilter | None = None, at: Snapshot | None = None) -> DataFrame:
        """Visible rows that pass the filter, with partition columns for further pruning."""
        at = at or self.snapshot()
        f = at.above_floor(f or P.LogFilter())
        if f is None:
            return self.spark.createDataFrame([], schema.STORED_LOGS)
        return P.apply_filters(self._scan_logs(f, at), f)

    def read_rollup(self, f: P.LogFilter | None = None, at: Snapshot | None = None) -> DataFrame:
        """Per-second cells of whole seconds within the filter's range; commits are partial counts."""
        at = at or self.snapshot()
        f = at.above_floor(f or P.LogFilter())
        if f is None:
            return self.spark.createDataFrame([], schema.STORED_ROLLUP).withColumnRenamed("start", "second")
        lo = -(-instants.to_millis(f.since) // 1000) * 1000 if f.since is not None else None
        hi = instants.to_millis(f.until) // 1000 * 1000 if f.until is not None else None
        cells = self._scan("rollup", schema.STORED_ROLLUP, self._cell_folders([(1, lo, hi)]), at).where(F.col("tier") == 1)
        if lo is not None:
            cells = cells.where(F.col("start") >= lo // 1000)
        if hi is not None:
            cells = cells.where(F.col("start") < hi // 1000)
        return cells.withColumnRenamed("start", "second")

    def _cell_folders(self, pieces) -> list[str]:
        """Folders that hold the cells of a cover's pieces; an open end is None."""
        found = []
        for tier, parts in groupby(sorted(pieces, key=lambda piece: piece[0]), key=lambda piece: piece[0]):
            wanted = [
                (date.min if lo is None else tiers.period_date(tier, lo), date.max if hi is None else tiers.period_date(tier, hi - 1))
                for _, lo, hi in parts
            ]
            for path in storage.children(self.spark, self._path(f"rollup/tier={tier}/period=*")):
                period = date.fromisoformat(path.rsplit("=", 1)[1])
                if any(lo <= period <= hi for lo, hi in wanted):
                    found.append(f"tier={tier}/period={period}")
        return found

    def _covered(self, f: P.LogFilter, bucket: str, at: Snapshot) -> tuple[DataFrame, DataFrame, tiers.Cover]:
        """Rows, cells and cover of a countable request above the floor. Folders that are not needed are not listed."""
        aggregate.check_bucket(bucket)
        c = tiers.cover(f.since, f.until, schema.BUCKET_MS[bucket], dict.fromkeys(tiers.TIERS))
        logs = self._scan("logs", schema.STORED_LOGS, self._dates_within(c.rows), at)
        return logs, self._scan("rollup", schema.STORED_ROLLUP, self._cell_folders(c.pieces), at), c

    def rejects(self) -> DataFrame:
        found = self.spark.read.schema(schema.STORED_REJECTS).parquet(self._path("rejects"))
        return found.where(self.snapshot().committed())

    def count_by_bucket(self, f: P.LogFilter, bucket: str, group_by: str | None = None) -> DataFrame:
        """Bucket counts from the stored rollup where it can answer, else from the rows."""
        if f.since is None or f.until is None:
            raise ValueError("since and until are required")
        at = self.snapshot()
        raised = at.above_floor(f) or f.between(f.until, f.until)
        if not raised.countable:
            return aggregate.count_by_bucket(self.read_logs(raised, at), raised, bucket, group_by)
        logs, cells, c = self._covered(raised, bucket, at)
        return aggregate.present(tiers.count_with_tiers(logs, cells, raised, c, bucket, group_by))

    def count_by_key(self, f: P.LogFilter, bucket: str) -> DataFrame:
        """``start_ms, service, level, count`` of a countable request."""
        at = self.snapshot()
        raised = at.above_floor(f) or f.between(f.until, f.until)
        logs, cells, c = self._covered(raised, bucket, at)
        return tiers.count_by_key(logs, cells, raised, c, bucket)

    def newest_page(
        self, f: P.LogFilter, limit: int = schema.DEFAULT_PAGE_LIMIT, cursor: Boundary | tuple[P.Instant, str] | None = None
    ) -> Page:
        """One page read from the newest dates back, over spans that double until the page is full."""
        cursor = checked_key(self.spark, f, cursor)
        at = self.snapshot()
        hi = instants.to_date(cursor[0]) if cursor else None
        if f.until is not None:
            until_day = instants.to_date(f.until)
            hi = until_day if hi is None else min(hi, until_day)
        days = [d for d in self.dates() if hi is None or d <= hi][::-1]
        span = 1
        while True:
            oldest = days[min(span, len(days)) - 1] if days else None
            lower = _midnight(oldest) if oldest and span < len(days) else None
            if lower is not None and f.since is not None:
                lower = max(lower, instants.to_millis(f.since))
            part = f if lower is None else replace(f, since=lower)
            if lower is not None and f.until is not None and instants.to_millis(f.until) < lower:
                span *= 2
                continue
            found = read_page(self.read_logs(part, at), P.LogFilter(), f, limit, cursor)
            if found.boundary is not None or lower is None:
                return found
            span *= 2

    # -- retention ----------------------------------------------------------------------------

    def apply_retention(self, now: P.Instant, days: float) -> dict:
        """Hide everything older than the cutoff at once and drop the folders of whole days before it.

        Rows are counted first; then the floor is stored, after which readers no longer see them; then
        folders go. A pass that stops anywhere in between is finished by the next one.
        """
        started = time.monotonic()
        cut = retention.cutoff(now, days)
        before = self.floor()
        if before is not None and before >= cut:
            cut, deleted = before, 0
        else:
            deleted = self.read_logs(P.LogFilter(until=cut)).count()
        storage.create_new(self.spark, self._path(f"floors/cutoff={cut}"))
        oldest_kept = instants.to_date(cut)
        for day in self.dates():
            if day < oldest_kept:
                storage.remove(self.spark, f"{self._path('logs')}/event_date={day}")
        for tier in tiers.TIERS:
            # A period goes once it ends before the first date that is kept.
            for path in storage.children(self.spark, self._path(f"rollup/tier={tier}/period=*")):
                if date.fromisoformat(path.rsplit("=", 1)[1]) < tiers.period_date(tier, cut):
                    storage.remove(self.spark, path)
        moment, took = datetime.fromtimestamp(cut / 1000, timezone.utc), int((time.monotonic() - started) * 1000)
        done = self.spark.createDataFrame([(moment, deleted, took)], schema.STORED_RETENTION)
        done.write.mode("append").parquet(self._path("retention"))
        return {"cutoff": moment, "rows_deleted": deleted, "duration_ms": took}

    def retention_passes(self) -> DataFrame:
        """``cutoff, rows_deleted, duration_ms`` of every pass; the duration includes removing folders."""
        return self.spark.read.schema(schema.STORED_RETENTION).parquet(self._path("retention"))


def _midnight(day: date) -> int:
    return instants.to_millis(datetime(day.year, day.month, day.day, tzinfo=timezone.utc))
