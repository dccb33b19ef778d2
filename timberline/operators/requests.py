"""Answers to a whole table of counting requests in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators.aggregate import safe_count
from timberline.operators.ranks import floored
from timberline.schema import BUCKET_MS, DAY_MS
from timberline.session import materialise

# A request's key without NULLs: ``shape`` tells which of service and level it is kept to (bits 2 and 1).
_KEY = ("shape", "service_key", "level_key")
_MINUTE_MS = 60_000
# Buckets of one size that are looked up together.
_BLOCK = 64


def _shaped(counted: DataFrame, shapes: list[int]) -> DataFrame:
    """``service, level, at, n`` summed under every key in use: with or without service and level, at most four.

    Rows without a service have no key by service.
    """
    has, none = F.lit(True), F.lit("")
    keys = [
        F.struct(
            F.lit(shape).alias("shape"),
            (F.col("service") if shape & 2 else none).alias("service_key"), (F.col("level") if shape & 1 else none).alias("level_key"),
            ((F.col("service").isNotNull() if shape & 2 else has) & (F.col("level").isNotNull() if shape & 1 else has)).alias("whole"),
        )
        for shape in shapes
    ]
    found = counted.select(F.explode(F.array(*keys)).alias("k"), "at", "n").where("k.whole")
    return found.groupBy("k.shape", "k.service_key", "k.level_key", "at").agg(F.sum("n").alias("n"))


def _series(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per request and group: ``request_id``, its key, ``group, since_ms, until_ms, size``.

    The groups of a request are those that have rows on one of its days; rows without a service are in none.
    """
    size = F.lit(None).cast("bigint")
    for bucket, ms in BUCKET_MS.items():
        size = F.when(F.col("bucket") == bucket, F.lit(ms).cast("bigint")).otherwise(size)
    usable = requests.withColumn("size", size).where("size IS NOT NULL AND until_ms > since_ms")
    columns = ("request_id", "request_no", "service", "level", "group", "since_ms", "until_ms", "size")
    plain = usable.where("group_by IS NULL").withColumn("group", F.lit(None).cast("string"))
    some, other, none = F.col("has_service"), F.col("has_level"), F.lit(None).cast("string")
    groups = F.array(*[
        F.struct(F.lit(by).alias("by"), group.alias("group"), besides.alias("besides"))
        for by, group, besides in (("service", some, other), ("service", some, none), ("level", other, some), ("level", other, none))
    ])
    # The groups of a day, by what a request is kept to besides (NULL: nothing).
    days = cells.where(F.col("tier") == 86_400).select(
        (F.col("start") * 1000).alias("has_day"), F.col("service").alias("has_service"), F.col("level").alias("has_level")
    ).distinct().select("has_day", F.explode(groups).alias("g")).select("has_day", "g.*").where("group IS NOT NULL").distinct()
    spread = usable.where("group_by IS NOT NULL").withColumn("day", F.explode(F.sequence(
        floored(F.col("since_ms"), DAY_MS), F.col("until_ms") - 1, F.lit(DAY_MS).cast("bigint")
    )))
    besides = F.when(F.col("group_by") == "service", F.col("level")).otherwise(F.col("service"))
    own = F.when(F.col("group_by") == "service", F.col("service")).otherwise(F.col("level"))
    found = spread.join(
        days, (F.col("day") == F.col("has_day")) & (F.col("group_by") == F.col("by")) & besides.eqNullSafe(F.col("besides"))
    ).where(own.isNull() | (own == F.col("group")))
    by_service = F.col("group_by") == "service"
    grouped = found.select(
        "request_id", "request_no", F.when(by_service, F.col("group")).otherwise(F.col("service")).alias("service"),
        F.when(by_service, F.col("level")).otherwise(F.col("group")).alias("level"), *columns[4:],
    ).distinct()
    return plain.select(*columns).unionByName(grouped).select(
        "request_id", (F.when(F.col("service").isNull(), 0).otherwise(2) + F.when(F.col("level").isNull(), 0).otherwise(1)).alias("shape"),
        F.coalesce("service", F.lit("")).alias("service_key"), F.coalesce("level", F.lit("")).alias("level_key"), *columns[4:],
    )


def _instants(logs: DataFrame, minutes: DataFrame, shapes: list[int]) -> DataFrame:
    """Key, ``minute, seconds``: counts of the milliseconds with rows by second, of the given minutes; at most 60 by 1,000."""
    ms = instants.millis(F.col("timestamp"))
    rows = logs.select("service", "level", ms.alias("at"), F.lit(1).cast("bigint").alias("n")).withColumn("of", floored(F.col("at"), _MINUTE_MS))
    counted = _shaped(rows.join(minutes.select(F.col("minute").alias("of")).distinct(), "of", "left_semi"), shapes)
    seconds = counted.groupBy(*_KEY, floored(F.col("at"), 1000).alias("second")).agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("at", "n")).alias("ticks"))
    return seconds.groupBy(*_KEY, floored(F.col("second"), _MINUTE_MS).alias("minute")).agg(
        F.collect_list(F.struct(F.col("second").alias("at"), "n", "ticks")).alias("seconds"))


def _opened(series: DataFrame, per_minute: DataFrame, logs: DataFrame, shapes: list[int]) -> DataFrame:
    """Key, ``minute, earlier, seconds`` of every minute that some bound lies in: the rows of the key before it in its bucket
    of each size wider than a minute, and those in it. A window runs over the minutes of one key and day."""
    bound = F.explode(F.array("since_ms", "until_ms"))
    places = series.select(*_KEY, bound.alias("at")).select(*_KEY, floored(F.col("at"), _MINUTE_MS).alias("at")).distinct()
    zero = F.lit(0).cast("bigint")
    line = per_minute.withColumn("open", F.lit(False)).unionByName(places.withColumn("n", zero).withColumn("open", F.lit(True)))
    line = line.groupBy(*_KEY, "at").agg(F.sum("n").alias("n"), F.max("open").alias("open")).withColumn("day", floored(F.col("at"), DAY_MS))
    wider = sorted((ms for ms in BUCKET_MS.values() if ms > _MINUTE_MS), reverse=True)
    for ms in wider:
        before = Window.partitionBy(*_KEY, "day", *([] if ms == DAY_MS else [floored(F.col("at"), ms)])).orderBy("at")
        line = line.withColumn(f"in_{ms}", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), zero))
    earlier = F.struct(*[F.col(f"in_{ms}") for ms in wider]).alias("earlier")
    opened = line.where("open").select(*_KEY, F.col("at").alias("minute"), earlier)
    return opened.join(_instants(logs, places.select(F.col("at").alias("minute")), shapes), [*_KEY, "minute"], "left")


def _rank(at: Column) -> Column:
    """The rows of the key between the beginning of the bucket that ``at`` lies in and ``at``."""
    zero = F.lit(0).cast("bigint")

    def before(cells: Column, inside) -> Column:
        return F.aggregate(cells, zero, lambda n, c: n + inside(c))

    ticks = lambda c: before(c["ticks"], lambda t: F.when(t["at"] < at, t["n"]).otherwise(zero))
    cut = before(F.col("seconds"), lambda c: F.when(c["at"] + 1000 <= at, c["n"]).when(c["at"] < at, ticks(c)).otherwise(zero))
    whole = zero
    for ms in BUCKET_MS.values():
        if ms > _MINUTE_MS:
            whole = F.when(F.col("size") == ms, F.col(f"earlier.in_{ms}")).otherwise(whole)
    return whole + F.coalesce(cut, zero)


def _blocks(per_minute: DataFrame) -> DataFrame:
    """Key, ``size, block, found``: counts of the buckets with rows, at most ``_BLOCK`` in a row."""
    sizes = F.explode(F.array(*[
        F.struct(F.lit(ms).cast("bigint").alias("size"), floored(F.col("at"), ms).alias("start")) for ms in BUCKET_MS.values()]))
    counted = per_minute.select(*_KEY, sizes.alias("b"), "n").groupBy(*_KEY, "b.size", "b.start").agg(F.sum("n").alias("n"))
    return counted.groupBy(*_KEY, "size", _block(F.col("start")).alias("block")).agg(F.collect_list(F.struct("start", "n")).alias("found"))


def _block(start: Column) -> Column:
    return start - F.pmod(start, F.col("size") * _BLOCK)


def answer_requests(requests: DataFrame, logs: DataFrame, cells: DataFrame) -> DataFrame:
    """``request_id, start, group, count`` of every request; buckets without rows are left out.

    ``requests``: ``request_id, service, level, since_ms, until_ms, bucket, group_by`` (NULL: not supplied), as
    ``resolve_requests`` gives them; those without a bucket have no answer. ``cells``: the tiers of ``cells_of``. Each
    bound is looked up once for its rank in its bucket, rows being read only for minutes that some bound cuts. Counts of whole
    buckets come in blocks, and a request meets blocks: its buckets are made after the last join, so none of them is
    shuffled. A repeated ``request_id`` repeats its counts.
    """
    asked = requests.select("request_id", "service", "level", "since_ms", "until_ms", "bucket", "group_by")
    # Written once: the requests are small, and whatever derives their bounds is not repeated for every look-up.
    numbered = materialise(asked.withColumn("request_no", F.monotonically_increasing_id()), "requests")
    series = materialise(_series(numbered, cells), "series")
    # At most four rows: which keys are in use.
    shapes = sorted(r["shape"] for r in series.select("shape").distinct().collect())
    if not shapes:
        return requests.limit(0).select(
            "request_id", F.lit("").alias("start"), F.lit("").alias("group"), F.lit(0).cast("bigint").alias("count")
        )
    minutes = cells.where(F.col("tier") == 60).select("service", "level", (F.col("start") * 1000).alias("at"), "n")
    per_minute = _shaped(minutes, shapes)
    opened, ranked = _opened(series, per_minute, logs, shapes), series
    for name in ("since", "until"):
        at = F.col(f"{name}_ms")
        ranked = ranked.withColumn("minute", floored(at, _MINUTE_MS)).join(opened, [*_KEY, "minute"]).select(
            *ranked.columns, _rank(at).alias(f"{name}_rank"))
    first, last = F.col("since_ms") - F.pmod("since_ms", "size"), F.col("until_ms") - F.pmod("until_ms", "size")
    spread = ranked.withColumn("first", first).withColumn("last", last).withColumn(
        "block", F.explode(F.sequence(_block(first), F.col("until_ms") - 1, F.col("size") * _BLOCK)))

    def less(start: Column, n: Column) -> Column:
        return F.struct(start.alias("start"), (n - F.when(start == F.col("first"), F.col("since_rank")).otherwise(0)).alias("n"))

    whole = F.filter("found", lambda b: (b["start"] >= F.col("first")) & (b["start"] < F.col("last")))
    # The last bucket ends with the request: it has what lies before the bound.
    ends = F.when(_block(F.col("last")) == F.col("block"), F.array(less(F.col("last"), F.col("until_rank"))))
    answers = F.concat(F.transform(whole, lambda b: less(b["start"], b["n"])), F.coalesce(ends, F.array().cast("array<struct<start:bigint,n:bigint>>")))
    counted = spread.join(_blocks(per_minute), [*_KEY, "size", "block"]).select("request_id", "group", F.explode(answers).alias("a"))
    return counted.where("a.n > 0").select(
        "request_id", instants.wire(F.col("a.start")).alias("start"), "group", safe_count("a.n").alias("count")
    )
