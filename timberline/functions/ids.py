"""Time-ordered identifiers that a retried task reproduces exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: accepted identifier notation.
UUID_PATTERN = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"

# Positions that fit the 12 bits of an id.
MAX_POSITIONS = 4096


def time_ordered_id(ms: Column, batch_id: Column, idx: Column) -> Column:
    """Version 7 UUID: 48 bits of time, the entry's position, then hash bits of (batch, position).

    A batch holds at most ``MAX_POSITIONS`` entries, so the position fits the 12 bits after the version
    and ids ascend within a batch.
    """
    moment = F.lpad(F.lower(F.hex(ms)), 12, "0")
    position = F.lpad(F.lower(F.hex(idx.cast("bigint"))), 3, "0")
    noise = F.sha2(F.concat_ws("/", batch_id, idx.cast("string")), 256)
    variant = F.substr(F.lit("89ab"), F.pmod(F.conv(noise.substr(1, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(
        moment.substr(1, 8), F.lit("-"), moment.substr(9, 4), F.lit("-7"), position,
        F.lit("-"), variant, noise.substr(2, 3), F.lit("-"), noise.substr(5, 12),
    )
