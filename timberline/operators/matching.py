"""Joins of the log table with marker sets and tables of saved filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators.ranks import Level, floored, ranked
from timberline.schema import DAY_MS, VISIBILITY_DEADLINE_MS
from timberline.session import MAX_BROADCAST_BYTES, broadcast_if_small, fits, materialise, on_all_cores

# Rows of a broadcast table; their bytes are bounded besides, see ``session.fits``.
MAX_BROADCAST_FILTERS = 100_000
MAX_BROADCAST_MARKERS = 1_000_000
SALTS = 16


def visibility_audit(
    markers: DataFrame,
    logs: DataFrame,
    deadline_ms: int = VISIBILITY_DEADLINE_MS,
    max_broadcast: int = MAX_BROADCAST_MARKERS,
) -> DataFrame:
    """For each accepted marker: whether and how long after sending it could be read.

    ``markers``: ``marker, sent_at``; ``logs`` needs ``attr_marker`` and ``ingested_at``. A checked
    small set of markers is broadcast to drop all other rows at the scan. Rows are reduced to the first
    sighting per marker before the join, so a marker written many times is one row per task; both
    sides then share one partitioning by marker.
    """
    rows = logs.where(F.col("attr_marker").isNotNull()).select(F.col("attr_marker").alias("marker"), "ingested_at")
    if fits(markers, max_broadcast):
        rows = rows.join(F.broadcast(markers.select("marker")), "marker", "left_semi")
    seen = rows.groupBy("marker").agg(F.min("ingested_at").alias("seen_at"))
    delay = instants.millis(F.col("seen_at")) - instants.millis(F.col("sent_at"))
    return markers.join(seen, "marker", "left").select(
        "marker", "sent_at", "seen_at",
        delay.alias("delay_ms"),
        F.coalesce(delay >= deadline_ms, F.lit(True)).alias("failed"),
    )


def visible_in_time(markers: DataFrame, logs: DataFrame, deadline_ms: int = VISIBILITY_DEADLINE_MS) -> DataFrame:
    """For each accepted marker: whether it could be read within the deadline, from the rows of that time alone.

    ``markers``: ``marker, sent_at``; ``logs`` needs ``attr_marker`` and ``ingested_at``. Both sides are cut into bins as
    long as the deadline: a marker meets the rows of its bin and the next, so no row later than its deadline. The span of
    all markers bounds the scan. A marker that is only seen later, or was sent at no known time, has failed and has no
    ``seen_at``; a row from before it was sent is not its row. Repeated markers are judged by their own ``sent_at``.
    """
    span = markers.agg(F.min("sent_at").alias("first"), F.max("sent_at").alias("last")).select(
        instants.millis(F.col("first")).alias("first"), instants.millis(F.col("last")).alias("last")
    ).first()
    ms = instants.millis(F.col("ingested_at"))
    rows = logs.where(F.col("attr_marker").isNotNull())
    if span["first"] is None:
        rows = rows.limit(0)
    else:
        rows = rows.where(F.col("ingested_at") >= instants.instant_lit(span["first"])).where(
            F.col("ingested_at") < instants.instant_lit(span["last"] + deadline_ms)
        )
    # A marker written many times in one millisecond is one row per task.
    seen = rows.groupBy(F.col("attr_marker").alias("marker"), ms.alias("seen_ms")).agg(F.lit(True).alias("seen")).select(
        "marker", "seen_ms", floored(F.col("seen_ms"), deadline_ms).alias("bin")
    )
    sent = markers.select("marker", "sent_at", instants.millis(F.col("sent_at")).alias("sent_ms")).where("sent_ms IS NOT NULL").distinct()
    own = floored(F.col("sent_ms"), deadline_ms)
    probes = sent.withColumn("bin", F.explode(F.array(own, own + deadline_ms)))
    delay = F.col("seen_ms") - F.col("sent_ms")
    first = probes.join(seen, ["marker", "bin"]).where((delay >= 0) & (delay < deadline_ms)).groupBy("marker", "sent_at").agg(
        F.min("seen_ms").alias("seen_ms"), F.min(delay).alias("delay_ms")
    )
    return markers.select("marker", "sent_at").join(first, ["marker", "sent_at"], "left").select(
        "marker", "sent_at", instants.from_millis(F.col("seen_ms")).alias("seen_at"), "delay_ms",
        F.col("delay_ms").isNull().alias("failed"),
    )


def visibility_totals(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("markers"),
        F.count_if("failed").alias("deadline_failures"),
        F.count_if(F.col("seen_at").isNull()).alias("missing"),
        F.max(F.when(~F.col("failed"), F.col("delay_ms"))).alias("max_delay_ms"),
    )


# -- saved filters ----------------------------------------------------------------------------
#
# Counting never pairs rows with filters. A filter's count is the rank of its upper bound less that of its lower bound,
# within the rows of its key: service, level and the row test (search text and attributes) it shares with other
# filters. Rows are counted per key and tick before anything is joined: an hour, or a millisecond in the hours some
# bound lies inside.
#
# Row tests are found by an inverted index. A row's features are the trigrams of its folded message and its attributes;
# a test needs all features of its own. They are counted per day first, so each test is anchored at the rarest of its
# features that day, is left out on days that lack one, and meets only the rows that hold its anchor. A few tests are
# cheaper tried than looked up: then those with attributes are anchored at one, and the others meet every row.

HOUR_MS = 3_600_000
_OPEN = 2**62  # stands for a missing upper bound
# Whether a key names a service and a level.
_SHAPES = {"any": (False, False), "of_level": (False, True), "of_service": (True, False), "of_both": (True, True)}
# Rows of one feature and day that one task tests.
ROWS_PER_SALT = 200_000
# So many tests without attributes are tried on every row instead of looked up by trigrams.
TRIED = 64
# Characters of a message beyond which its trigrams are listed in one go instead of cut one by one.
LONG = 512
# The feature of every row, for tests that have none of their own.
_ANY = ""


def _wanted(filters: DataFrame) -> DataFrame:
    """Saved filters in join form, each row with a number of its own; ``test`` names the row test, NULL when there is none.

    ``key`` is the test, level and service in one text, each empty where any will do.
    """
    q = F.lower("q")
    pairs = F.when(F.size("attr") > 0, F.array_sort(F.map_entries("attr")))
    test = F.when(q.isNotNull() | pairs.isNotNull(), F.sha2(F.to_json(F.struct(q.alias("q"), pairs.alias("a"))), 256))
    return filters.select(
        "filter_id", "service", "level",
        instants.millis(F.col("since")).alias("since"),
        instants.millis(F.col("until")).alias("until"),
        q.alias("q"), pairs.alias("pairs"), test.alias("test"), _key(test, F.col("level"), F.col("service")).alias("key"),
        F.monotonically_increasing_id().alias("no"),
    )


def _key(test: Column, level: Column, service: Column) -> Column:
    """The service comes last, as it may hold any character."""
    none = F.lit("")
    return F.concat(
        F.coalesce(test, none), F.lit("/"), F.coalesce(level, none), F.lit("/"), F.coalesce(F.concat(F.lit("="), service), none)
    )


def _rows(logs: DataFrame) -> DataFrame:
    rows = logs.select("id", "service", "level", "message", "attr", instants.millis(F.col("timestamp")).alias("ms"))
    return rows.withColumn("day", floored(F.col("ms"), DAY_MS))


def _matches(log_attr: Column, wanted: Column) -> Column:
    return F.coalesce(
        F.forall(wanted, lambda e: F.coalesce(F.try_element_at(log_attr, e["key"]) == e["value"], F.lit(False))),
        F.lit(True),
    )


def _grams(folded: Column) -> Column:
    """Distinct trigrams of a folded text, as features."""
    found = F.regexp_extract_all(folded, F.lit(r"(?s)(?=(.{3}))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda g: F.concat(F.lit("t"), g)))


def _named(pairs: Column) -> Column:
    """Attributes as features."""
    return F.transform(pairs, lambda e: F.concat(F.lit("a"), F.length(e["key"]).cast("string"), F.lit(":"), e["key"], e["value"]))


def _tests(wanted: DataFrame) -> DataFrame:
    """Each distinct row test once, with the widest range and the keys any of its filters asks for, and its features."""
    def widest(bound: str, pick) -> Column:
        return F.when(F.count_if(F.col(bound).isNull()) == 0, pick(bound))

    found = wanted.where(F.col("test").isNotNull()).groupBy("test").agg(
        F.first("q").alias("q"), F.first("pairs").alias("pairs"),
        widest("since", F.min).alias("lo"), widest("until", F.max).alias("hi"),
        *[F.bool_or(F.col("service").isNotNull().eqNullSafe(F.lit(s)) & F.col("level").isNotNull().eqNullSafe(F.lit(v))).alias(name)
          for name, (s, v) in _SHAPES.items()],
    )
    none = F.array().cast("array<string>")
    own = F.concat(F.coalesce(_grams(F.col("q")), none), F.coalesce(_named(F.col("pairs")), none))
    return found.withColumn("features", F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(_ANY))))


def _spread(logs: DataFrame, features: DataFrame, *keys: str) -> DataFrame:
    """Rows once per feature among the given ones, with ``folded`` (the message) and ``feature``."""
    rows = _rows(logs).withColumn("folded", F.lower("message")).drop("message")
    long = F.length("folded") > LONG
    rows = rows.withColumn("named", _named(F.map_entries("attr"))).withColumn("grams", F.when(long, _grams(F.col("folded"))))
    # Places below 0 are attributes, 0 stands for any row, above are trigrams; a short text's are cut where they are used.
    last = F.when(long, F.size("grams")).otherwise(F.greatest(F.length("folded") - 2, F.lit(0)))
    first = -F.greatest(F.coalesce(F.size("named"), F.lit(0)), F.lit(0))
    placed = rows.withColumn("i", F.explode(F.sequence(first, F.coalesce(last, F.lit(0)))))
    gram = F.substring("folded", F.col("i"), F.lit(3))
    feature = F.when(F.col("i") < 0, F.get("named", -F.col("i") - 1)).when(F.col("i") == 0, F.lit(_ANY)).when(
        F.col("grams").isNotNull(), F.get("grams", F.col("i") - 1)
    ).otherwise(F.concat(F.lit("t"), gram))
    found = placed.withColumn("feature", feature).join(features, list(keys), "left_semi")
    # Each feature of a row once: a short text's trigram counts where it stands first.
    return found.where((F.col("i") <= 0) | F.col("grams").isNotNull() | (F.position(gram, F.col("folded")) == F.col("i"))).drop("named", "grams", "i")


def anchors_of(logs: DataFrame, tests: DataFrame, max_broadcast: int) -> DataFrame:
    """Where each test is looked for: ``test, q, pairs, lo, hi, day, feature, n``, ``n`` rows hold the feature that day."""
    listed = tests.select("test", "lo", "hi", F.size("features").alias("of"), F.explode("features").alias("feature"))
    counts = materialise(
        _spread(logs, broadcast_if_small(listed.select("feature").distinct(), max_broadcast), "feature")
        .groupBy("day", "feature").agg(F.count(F.lit(1)).alias("n")),
        "features",
    )
    placed = listed.join(counts, "feature").where(
        (F.col("lo").isNull() | (F.col("day") + DAY_MS > F.col("lo"))) & (F.col("hi").isNull() | (F.col("day") < F.col("hi")))
    )
    rarest = placed.groupBy("test", "day").agg(
        F.min(F.struct("n", "feature")).alias("rarest"), F.count(F.lit(1)).alias("has"), F.first("of").alias("of")
    ).where("has = of")
    return rarest.select("test", "day", "rarest.feature", "rarest.n").join(tests.drop("features"), "test")


def tested_rows(logs: DataFrame, tests: DataFrame, max_broadcast: int) -> DataFrame:
    """``id, service, level, ms, test`` and the test's keys: rows that pass a row test, once per test passed."""
    texts = F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length(F.to_json("pairs")), F.lit(0))
    size = tests.agg(F.count(F.lit(1)).alias("n"), F.sum(texts).alias("bytes"), F.count_if(F.col("pairs").isNull()).alias("bare")).first()
    if size["n"] <= max_broadcast and (size["bytes"] or 0) <= MAX_BROADCAST_BYTES and size["bare"] <= TRIED:
        met = _tried(logs, tests)
    else:
        met = _looked_up(logs, tests, max_broadcast)
    holds = (
        (F.col("lo").isNull() | (F.col("ms") >= F.col("lo")))
        & (F.col("hi").isNull() | (F.col("ms") < F.col("hi")))
        & (F.col("q").isNull() | F.contains(F.col("folded"), F.col("q")))
        & (F.col("pairs").isNull() | _matches(F.col("attr"), F.col("pairs")))
    )
    return met.where(holds).select("id", "service", "level", "ms", "test", *_SHAPES)


def _tried(logs: DataFrame, tests: DataFrame) -> DataFrame:
    """Rows beside the broadcast tests that they share an attribute with, or that have no attribute."""
    rows = _rows(logs).withColumn("folded", F.lower("message")).drop("message")
    of_row = F.concat(F.array(F.lit(_ANY)), F.coalesce(_named(F.map_entries("attr")), F.array().cast("array<string>")))
    placed = tests.withColumn("feature", F.coalesce(F.get(_named(F.col("pairs")), F.lit(0)), F.lit(_ANY))).drop("features")
    return rows.withColumn("feature", F.explode(of_row)).join(F.broadcast(placed), "feature")


def _looked_up(logs: DataFrame, tests: DataFrame, max_broadcast: int) -> DataFrame:
    """Rows and tests that meet on day and anchor.

    A place with many rows is split over as many salts as its counted rows need.
    """
    anchors = materialise(anchors_of(logs, tests, max_broadcast), "anchors")
    salts = F.call_function("div", F.col("n") - 1, F.lit(ROWS_PER_SALT)) + 1
    places = anchors.select("day", "feature", salts.alias("salts")).distinct()
    if fits(anchors, max_broadcast):
        # No shuffle of rows, so nothing to split.
        rows = _spread(logs, F.broadcast(places.select("day", "feature")), "day", "feature")
        return rows.join(F.broadcast(anchors.drop("n")), ["day", "feature"])
    rows = _spread(logs, places.select("day", "feature"), "day", "feature").join(places.where("salts > 1"), ["day", "feature"], "left")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0).cast("bigint")))
    wanted = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("n")
    return rows.join(wanted, ["day", "feature", "salt"])


def _keyed(rows: DataFrame) -> DataFrame:
    """``id, key, ms`` under the keys in use, at most four a row and test: the columns of ``_SHAPES`` tell which.

    Rows without a service have no key by service.
    """
    none = F.lit(None).cast("string")
    keys = []
    for shape, (s, v) in _SHAPES.items():
        needed = F.col(shape)
        for name in ["service"] * s + ["level"] * v:
            needed = needed & F.col(name).isNotNull()
        keys.append(F.when(needed, _key(F.col("test"), F.col("level") if v else none, F.col("service") if s else none)))
    return rows.select("id", "ms", F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL")


def _in_use(wanted: DataFrame) -> tuple[set, bool]:
    """Which keys are in use, with and without a row test (at most eight), and whether a bound lies inside an hour."""
    shape = F.struct(*[F.col(c).isNotNull().alias(c) for c in ("service", "level", "test")])
    inside = F.bool_or((F.pmod("since", F.lit(HOUR_MS)) != 0) | F.lit(False)) | F.bool_or((F.pmod("until", F.lit(HOUR_MS)) != 0) | F.lit(False))
    found = wanted.groupBy(shape.alias("shape")).agg(F.coalesce(inside, F.lit(False)).alias("inside")).collect()
    return {tuple(r["shape"]) for r in found}, any(r["inside"] for r in found)


def _keyed_rows(logs: DataFrame, wanted: DataFrame, used: set, max_broadcast: int) -> DataFrame | None:
    """Rows under every key some filter uses, None without filters."""
    logs, parts = on_all_cores(logs), []
    if any(not tested for *_, tested in used):
        flags = [F.lit((*shape, False) in used).alias(name) for name, shape in _SHAPES.items()]
        parts.append(_keyed(_rows(logs).select("*", F.lit(None).cast("string").alias("test"), *flags)))
    if any(tested for *_, tested in used):
        parts.append(_keyed(tested_rows(logs, _tests(wanted), max_broadcast)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def match_saved_filters(
    logs: DataFrame, filters: DataFrame, max_broadcast: int = MAX_BROADCAST_FILTERS
) -> DataFrame:
    """``filter_id, matches`` for every saved filter, 0 without a match; NULL fields are not supplied.

    ``filters``: ``filter_id, service, level, since, until, q, attr``. A repeated ``filter_id`` has a count per row.
    """
    wanted = materialise(_wanted(filters), "filters")
    used, cut = _in_use(wanted)
    keyed = _keyed_rows(logs, wanted, used, max_broadcast)
    if keyed is None:
        return filters.select("filter_id", F.lit(0).cast("bigint").alias("matches"))
    bounds = F.array(
        F.struct(F.col("since").alias("at"), F.lit(-1).alias("sign")),
        F.struct(F.coalesce("until", F.lit(_OPEN)).alias("at"), F.lit(1).alias("sign")),
    )
    probes = wanted.select("no", "key", F.explode(bounds).alias("b")).select("no", "key", "b.at", "b.sign").where("at IS NOT NULL")

    tick = hour = floored(F.col("ms"), HOUR_MS)
    if cut:
        # Hours that some bound lies inside; the rows of all others are counted by the hour.
        inner = probes.where((F.col("at") < _OPEN) & (F.pmod("at", F.lit(HOUR_MS)) != 0)).select(
            floored(F.col("at"), HOUR_MS).alias("hour")
        ).distinct()
        keyed = keyed.withColumn("in_hour", hour).join(
            broadcast_if_small(inner, max_broadcast), F.col("in_hour") == F.col("hour"), "left"
        )
        tick = F.when(F.col("hour").isNotNull(), F.col("ms")).otherwise(F.col("in_hour"))
    ticks = materialise(keyed.groupBy("key", tick.alias("at")).agg(F.count(F.lit(1)).alias("n")), "ticks")

    def by(size: int):
        return lambda blocks: ticks.groupBy("key", floored(F.col("at"), size).alias("at")).agg(F.sum("n").alias("n"))

    levels = [Level(HOUR_MS, None, by(HOUR_MS))]
    if cut:
        # No window holds more than the seconds of an hour or the milliseconds of a second.
        levels += [Level(1000, HOUR_MS, by(1000)), Level(1, 1000, by(1))]
    found = probes.join(ranked(probes, ("key",), levels), ["key", "at"])
    counts = found.groupBy("no").agg(F.sum(F.col("sign") * F.col("before")).alias("n"))
    return wanted.select("no", "filter_id").join(counts, "no", "left").select(
        "filter_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).alias("matches")
    )


def match_rows(logs: DataFrame, filters: DataFrame, max_broadcast: int = MAX_BROADCAST_FILTERS) -> DataFrame:
    """``filter_id, id`` for every row a saved filter selects: as many rows as there are matches.

    Filters and rows meet on key and day. A checked small table of filters and days is broadcast;
    otherwise every day is split over salts. To count only, use ``match_saved_filters``.
    """
    wanted = _wanted(filters)
    keyed = _keyed_rows(logs, wanted, _in_use(wanted)[0], max_broadcast)
    none = filters.select("filter_id", F.lit(None).cast("string").alias("id")).limit(0)
    span = _rows(logs).agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    if keyed is None or span["first"] is None:
        return none
    first = F.greatest(F.coalesce(floored(F.col("since"), DAY_MS), F.lit(span["first"])), F.lit(span["first"]))
    last = F.least(F.coalesce(floored(F.col("until"), DAY_MS), F.lit(span["last"])), F.lit(span["last"]))
    daily = wanted.where(first <= last).select(
        "filter_id", F.col("key").alias("of_key"), "since", "until",
        F.explode(F.sequence(first, last, F.lit(DAY_MS).cast("bigint"))).alias("on_day"),
    )
    rows = keyed.withColumn("day", floored(F.col("ms"), DAY_MS))
    condition = F.col("day") == F.col("on_day")
    if fits(daily, max_broadcast):
        daily = F.broadcast(daily)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        daily = daily.withColumn("on_salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
        condition = condition & (F.col("salt") == F.col("on_salt"))
    condition = condition & (F.col("key") == F.col("of_key"))
    condition = condition & (F.col("since").isNull() | (F.col("ms") >= F.col("since")))
    condition = condition & (F.col("until").isNull() | (F.col("ms") < F.col("until")))
    return rows.join(daily, condition).select("filter_id", "id")
