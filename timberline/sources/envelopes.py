"""Batch documents: reading them, judging the envelope, one row per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.attributes import kind, object_fields
from timberline.functions.ids import MAX_POSITIONS
from timberline.schema import MAX_LOGS_PER_BATCH

# Batch-level messages.
MALFORMED = "malformed JSON"
NOT_AN_ENVELOPE = "body must be an object containing a logs array"


def read_envelopes(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """One row per batch document: a whole file, or one line of a file.

    A file is read by one task in both cases: only then are line numbers, and with them ids, the same however the
    read is split. Files of lines should therefore stay well below an executor's memory. Their lines are dealt to all
    cores before any document is looked at.
    """
    return identified(spark.read.text(path, wholetext=True), whole_files)


def stream_envelopes(spark: SparkSession, path: str, whole_files: bool = True, **limits) -> DataFrame:
    """The same rows as a stream. ``limits``: ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``."""
    return identified(spark.readStream.options(**limits).text(path, wholetext=True), whole_files)


def identified(files: DataFrame, whole_files: bool = True) -> DataFrame:
    """Batch id from where the document lies (file and line) and what it says: a re-read gives the same id, and
    identical documents have different ones."""
    lines = F.split(F.regexp_replace("value", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)
    documents = F.array("value") if whole_files else F.when(F.col("value") != "", lines)
    placed = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(documents).alias("line", "body"))
    if not whole_files:
        placed = placed.repartition(files.sparkSession.sparkContext.defaultParallelism, "path", "line")
    place = F.concat_ws("#", "path", F.col("line").cast("string"), F.sha2("body", 256))
    return placed.select(
        F.sha2(place, 256).substr(1, 32).alias("batch_id"), F.current_timestamp().alias("received_at"), "body",
    )


def _document(body: Column) -> Column:
    """``[body, digest]`` as VARIANT.

    JSON readers stop after the first complete value and ignore what follows. The digest behind the
    body can only be found at position 1 when the body is exactly one value, because a body cannot
    contain its own digest.
    """
    return F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"'), F.sha2(body, 256), F.lit('"]')))


def check_envelope(envelopes: DataFrame, max_logs: int = MAX_LOGS_PER_BATCH) -> DataFrame:
    """Add ``entries`` (ARRAY<VARIANT>, NULL when refused), ``envelope_error`` (NULL when fine) and
    ``envelope_no``, which tells copies of one batch id apart.

    Streams do not offer such a number; theirs is 0, and a batch id stands for all its copies.
    """
    number = F.lit(0).cast("bigint") if envelopes.isStreaming else F.monotonically_increasing_id()
    if max_logs > MAX_POSITIONS:
        raise ValueError(f"ids number the entries of a batch up to {MAX_POSITIONS}")
    parsed = envelopes.withColumn("_doc", _document(F.col("body"))).withColumn("envelope_no", number)
    whole = F.try_variant_get("_doc", "$[1]", "string") == F.sha2("body", 256)
    parsed = parsed.select(
        *envelopes.columns, "envelope_no",
        F.coalesce(whole, F.lit(False)).alias("_whole"),
        F.try_variant_get("_doc", "$[0].logs", "variant").alias("_logs"),
        F.try_variant_get("_doc", "$[0].logs", "array<variant>").alias("_entries"),
    )
    error = (
        F.when(~F.col("_whole"), F.lit(MALFORMED))
        .when(F.coalesce(~F.startswith(kind(F.col("_logs")), F.lit("ARRAY")), F.lit(True)), F.lit(NOT_AN_ENVELOPE))
        .when(F.size("_entries") > max_logs, F.lit(f"logs must contain at most {max_logs} entries"))
    )
    return parsed.withColumn("envelope_error", error).select(
        *envelopes.columns, "envelope_no",
        F.when(F.col("envelope_error").isNull(), F.col("_entries")).alias("entries"),
        "envelope_error",
    )


# An entry of exactly the known fields with the right JSON types and at most 64 scalar attributes.
_KEY = r"(?:[A-Za-z0-9_]{1,256}|`[^`]{1,256}`)"
_SCALAR = r"(?:STRING|BOOLEAN|BIGINT|DECIMAL\(\d+,\d+\))"
REGULAR_SHAPE = (
    rf"\AOBJECT<(?:attributes: OBJECT<(?:{_KEY}: {_SCALAR}(?:, )?){{0,64}}>, )?"
    r"level: STRING, message: STRING, service: STRING, timestamp: STRING>\z"
)


def explode_entries(checked: DataFrame) -> DataFrame:
    """One row per entry: the batch columns, ``envelope_error, idx, entry, regular, key_order``.

    ``regular`` tells that the entry's fields and JSON types are in order; only the other entries need
    the checks one by one. A batch without entries (refused, or an empty array) keeps one row with a
    NULL ``idx``, so that its outcome is known without reading the bodies a second time.

    VARIANT keeps object keys sorted. Which unknown field comes first in the text only matters for an
    entry with more than one of them, that is with more than five fields besides the attributes; the
    texts are read again just for such batches and only the key list travels on.
    """
    judged = F.transform(
        "entries",
        lambda e: F.struct(e.alias("entry"), kind(e).rlike(REGULAR_SHAPE).alias("regular")),
    )

    def crowded(e: Column) -> Column:
        names = F.map_keys(object_fields(e["entry"]))
        extra = F.size(names) - F.when(F.array_contains(names, "attributes"), 1).otherwise(0)
        return ~e["regular"] & F.coalesce(extra > 5, F.lit(False))

    texts = F.from_json(F.get_json_object("body", "$.logs"), "array<string>")
    keys = F.when(F.exists("_judged", crowded), F.transform(texts, lambda t: F.json_object_keys(t)))
    exploded = checked.select(
        "batch_id", "envelope_no", "received_at", "envelope_error", "body", judged.alias("_judged")
    ).select(
        "batch_id", "envelope_no", "received_at", "envelope_error", keys.alias("_keys"),
        F.posexplode_outer("_judged").alias("idx", "_e"),
    )
    return exploded.select(
        "batch_id", "envelope_no", "received_at", "envelope_error", "idx",
        F.col("_e.entry").alias("entry"), F.col("_e.regular").alias("regular"),
        F.get("_keys", F.col("idx")).alias("key_order"),
    )
