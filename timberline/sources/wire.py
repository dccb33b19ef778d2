"""Logs in the form readers receive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import instants


def to_wire(logs: DataFrame) -> DataFrame:
    """Instants as text, attributes as JSON with their original types."""
    return logs.select(
        "id", instants.wire_timestamp(F.col("timestamp")).alias("timestamp"),
        "level", "service", "message", "attributes",
    )


def to_json_lines(logs: DataFrame) -> DataFrame:
    """One JSON document per row; ``attributes`` is nested, not quoted."""
    wire = to_wire(logs)
    head = F.to_json(F.struct("id", "timestamp", "level", "service", "message"))
    body = F.concat(F.left(head, F.length(head) - 1), F.lit(',"attributes":'), F.col("attributes"), F.lit("}"))
    return wire.select(body.alias("value"))
