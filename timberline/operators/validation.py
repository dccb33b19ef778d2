"""Entry validation and normalisation as projections; the first failing check names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import attributes as A
from timberline.functions import ids, instants
from timberline.schema import (
    ENTRY_FIELDS,
    FUTURE_TOLERANCE_MS,
    LEVELS,
    MAX_ATTRIBUTE_KEY_CHARS,
    MAX_ATTRIBUTES_BYTES,
    MAX_LOGS_PER_BATCH,
    MAX_MESSAGE_CHARS,
    MAX_SERVICE_CHARS,
    REQUIRED_FIELDS,
)
from timberline.sources.envelopes import MALFORMED, check_envelope, explode_entries

# Entry-level messages.
BAD_ATTRIBUTES = "attributes must be a flat object with string, number, or boolean values"
BAD_INSTANT = "invalid timestamp: expected an ISO 8601 instant"
TOO_EARLY = "timestamp is more than 5 minutes in the future"
ATTRIBUTES_TOO_LARGE = f"attributes exceed {MAX_ATTRIBUTES_BYTES} bytes"
NUL = "\u0000"


def check_required(fields: Column) -> Column:
    missing = [
        F.when(~F.map_contains_key(fields, name), F.lit(f"missing required field: {name}"))
        for name in REQUIRED_FIELDS
    ]
    return F.coalesce(F.when(fields.isNull(), F.lit("entry has an invalid type")), *missing)


def check_unknown_fields(fields: Column, key_order: Column) -> Column:
    keys = F.coalesce(key_order, F.map_keys(fields))
    first = F.get(F.array_except(keys, F.array(*map(F.lit, ENTRY_FIELDS))), F.lit(0))
    return F.when(first.isNotNull(), F.concat(F.lit("unknown field: "), first))


def _shown(value: Column) -> Column:
    """How a level of the wrong value or type appears inside its message."""
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
    texts = F.transform(
        items,
        lambda v: F.when(F.startswith(A.kind(v), F.lit("OBJECT")), "[object Object]").otherwise(
            F.coalesce(A.scalar_plain(v), F.lit(""))
        ),
    )
    return F.when(F.is_variant_null(value), "null").otherwise(F.array_join(texts, ","))


def is_text(value: Column) -> Column:
    return F.coalesce(A.kind(value) == "STRING", F.lit(False))


def check_level(text: Column, value: Column, regular: Column) -> Column:
    """``value`` is the field as VARIANT, read only for an irregular entry."""
    known = F.coalesce(text.isin(*LEVELS), F.lit(False)) & (regular | is_text(value))
    return F.when(
        ~known, F.concat(F.lit("invalid level: '"), F.when(regular, text).otherwise(_shown(value)), F.lit("'"))
    )


def check_text(name: str, text: Column, value: Column, regular: Column, max_chars: int) -> Column:
    return (
        F.when(~(regular | is_text(value)), F.lit(f"{name} has an invalid type"))
        .when(text == "", F.lit(f"{name} must not be empty"))
        .when(F.length(text) > max_chars, F.lit(f"{name} is too long"))
        .when(F.contains(text, F.lit(NUL)), F.lit(f"{name} contains a NUL character"))
    )


def check_attributes(present: Column, entries: Column) -> Column:
    """``entries`` are those of the attribute object, NULL when it is not an object."""
    flat = F.forall(
        entries,
        lambda e: e["text"]["json"].isNotNull()
        & F.length(e["key"]).between(1, MAX_ATTRIBUTE_KEY_CHARS)
        & ~F.contains(e["key"], F.lit(NUL)) & ~F.contains(e["text"]["plain"], F.lit(NUL)),
    )
    return F.when(present & ~F.coalesce(flat, F.lit(False)), F.lit(BAD_ATTRIBUTES))


def check_future(ms: Column, now_ms: Column) -> Column:
    return F.when(ms > now_ms + FUTURE_TOLERANCE_MS, F.lit(TOO_EARLY))


def check_attr_bytes(attributes: Column) -> Column:
    return F.when(F.octet_length(attributes) > MAX_ATTRIBUTES_BYTES, F.lit(ATTRIBUTES_TOO_LARGE))


def validate_entries(entries: DataFrame) -> DataFrame:
    """The batch columns, ``envelope_error, idx, reason`` and the normalised log columns.

    The log columns are NULL when the entry is refused, and on the one row of a batch without entries
    (NULL ``idx``, NULL ``reason``). ``received_at`` is the one clock of a batch: it bounds the future
    check and stamps the ids.

    Columns are built in stages so that each is computed once. Regular entries skip the checks of
    fields and types; attributes are rewritten only where a number may need it.
    """
    entries.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    here, regular = F.col("idx").isNotNull(), F.col("regular")
    passed = ("batch_id", "envelope_no", "received_at", "envelope_error", "idx")
    texts = ("timestamp", "level", "service", "message")

    staged = entries.select(
        *passed, "regular", "key_order",
        F.when(~regular, A.object_fields(F.col("entry"))).alias("_fields"),
        F.try_variant_get("entry", "$.attributes", "variant").alias("_attributes"),
        *[F.try_variant_get("entry", f"$.{n}", "string").alias(f"_{n}") for n in texts],
    ).withColumn("_json", F.to_json("_attributes"))
    rewrite = ~regular | A.needs_rewriting(F.col("_json"))
    staged = staged.withColumn(
        "_bag", F.when(rewrite, A.attribute_entries(A.object_fields(F.col("_attributes"))))
    )

    def field(name: str) -> Column:
        return F.try_element_at("_fields", F.lit(name))

    staged = staged.withColumn(
        "_shape",
        F.when(here, F.coalesce(
            F.when(~regular, F.coalesce(
                check_required(F.col("_fields")),
                check_unknown_fields(F.col("_fields"), F.col("key_order")),
                F.when(~is_text(field("timestamp")), F.lit("timestamp has an invalid type")),
            )),
            check_level(F.col("_level"), field("level"), regular),
            check_text("service", F.col("_service"), field("service"), regular, MAX_SERVICE_CHARS),
            check_text("message", F.col("_message"), field("message"), regular, MAX_MESSAGE_CHARS),
            F.when(rewrite, check_attributes(F.col("_attributes").isNotNull(), F.col("_bag"))),
        )),
    )
    sound = here & F.col("_shape").isNull()
    staged = staged.select(
        *passed, "_level", "_service", "_message", "_shape", "_bag", "_json",
        F.when(sound, instants.instant_millis(F.col("_timestamp"))).alias("_ms"),
        F.when(
            sound, F.coalesce(A.attributes_json(F.col("_bag")), F.col("_json"), F.lit("{}"))
        ).alias("_attributes_json"),
    )
    reason = F.when(here, F.coalesce(
        F.col("_shape"),
        F.when(F.col("_ms").isNull(), F.lit(BAD_INSTANT)),
        check_future(F.col("_ms"), instants.millis(F.col("received_at"))),
        check_attr_bytes(F.col("_attributes_json")),
    ))
    staged = staged.withColumn("reason", reason).withColumn("_kept", here & F.col("reason").isNull())
    empty = F.create_map().cast("map<string,string>")
    attr = F.coalesce(A.attributes_map(F.col("_bag")), A.settled_map(F.col("_json")), empty)
    ident = ids.time_ordered_id(instants.millis(F.col("received_at")), F.col("batch_id"), F.col("idx"))
    rows = staged.select(
        *passed, "reason",
        *[
            F.when(F.col("_kept"), value).alias(name)
            for name, value in (
                ("id", ident),
                ("timestamp", instants.from_millis(F.col("_ms"))),
                ("level", F.col("_level")),
                ("service", F.col("_service")),
                ("message", F.col("_message")),
                ("attributes", F.col("_attributes_json")),
                ("attr", attr),
            )
        ],
    )
    # A predicate on the result must not be pushed below this: it would repeat the whole derivation.
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def validate_envelopes(envelopes: DataFrame, max_logs: int = MAX_LOGS_PER_BATCH) -> DataFrame:
    """Envelope check, explode and entry validation in one narrow stage."""
    envelopes.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return validate_entries(explode_entries(check_envelope(envelopes, max_logs)))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted logs and rejected entries of the same validated frame."""
    accepted = validated.where(F.col("id").isNotNull()).select(
        "id", "timestamp", "level", "service", "message", "attributes", "attr",
        F.col("received_at").alias("ingested_at"), "batch_id", "idx",
    )
    rejected = validated.where(F.col("reason").isNotNull()).select("batch_id", "idx", "reason")
    return accepted, rejected


def normalized_bytes(logs: DataFrame) -> DataFrame:
    """Add ``bytes``: UTF-8 size of the six stored texts of a row."""
    return logs.withColumn("bytes", stored_bytes())


def stored_bytes() -> Column:
    sizes = [F.octet_length(c) for c in ("id", "level", "service", "message", "attributes")]
    total = F.octet_length(instants.wire_timestamp(F.col("timestamp")))
    for size in sizes:
        total = total + size
    return total.cast("bigint")


def batch_summary(validated: DataFrame) -> DataFrame:
    """One row per batch: outcome, error, accepted count, bytes and the rejected entries by index.

    Entries are counted before the shuffle, so one row per batch and task travels. Copies of a batch
    are batches of their own. The list of rejected entries is bounded, because an envelope past the
    entry limit is refused unexploded.
    """
    kept = F.col("id").isNotNull()
    per_batch = validated.groupBy("batch_id", "envelope_no").agg(
        F.max("envelope_error").alias("error"),
        F.count_if(kept).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected_count"),
        F.coalesce(F.sum(F.when(kept, stored_bytes())), F.lit(0)).alias("normalized_bytes"),
        F.array_sort(
            F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("idx", "reason")))
        ).alias("rejected"),
    )
    outcome = (
        F.when(F.col("error") == MALFORMED, "malformed")
        .when(F.col("error").isNotNull(), "bad_envelope")
        .when(F.col("accepted") == 0, "all_invalid")
        .otherwise("ok")
    )
    return per_batch.select(
        "batch_id", outcome.alias("outcome"), "error", "accepted", "rejected_count", "normalized_bytes", "rejected"
    )


def constraint_audit(logs: DataFrame) -> DataFrame:
    """``rule, violations`` over an existing table; one pass for the row rules, one for the key rule."""
    def bad(name: str, condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)

    nullable = [c for c in ("id", "timestamp", "level", "service", "message", "attributes")]
    rules = [bad(f"{c}_not_null", F.col(c).isNull()) for c in nullable] + [
        bad("level_known", ~F.col("level").isin(*LEVELS)),
        bad("service_not_empty", F.length("service") == 0),
        bad("message_not_empty", F.length("message") == 0),
        bad("attributes_object", ~F.coalesce(
            F.startswith(A.kind(F.try_parse_json("attributes")), F.lit("OBJECT")), F.lit(False)
        ) & F.col("attributes").isNotNull()),
    ]
    names = [f"{c}_not_null" for c in nullable] + [
        "level_known", "service_not_empty", "message_not_empty", "attributes_object"
    ]
    rows = logs.agg(*rules).select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in names])).alias("r")
    ).select("r.*")
    repeated = (
        logs.groupBy("timestamp", "id").count().where(F.col("count") > 1)
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
        .select(F.lit("key_unique").alias("rule"), F.col("violations").cast("bigint").alias("violations"))
    )
    return rows.unionByName(repeated)
