"""Live tumbling counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.operators.aggregate import check_bucket, group_column
from timberline.schema import BUCKET_MS

# Fixed value: how far behind the newest row a late row still changes a live count.
LATENESS = "2 hours"


def stream_counts(
    logs: DataFrame, bucket: str, group_by: str | None = None, lateness: str = LATENESS
) -> DataFrame:
    """``start, group, count`` of a stream of logs; state older than the watermark is dropped.

    The stored table and its rollup take rows of any age; only these counts stop changing.
    """
    check_bucket(bucket)
    size = f"{BUCKET_MS[bucket]} milliseconds"
    windowed = logs.withWatermark("timestamp", lateness).groupBy(
        F.window("timestamp", size).alias("w"), group_column(group_by).alias("group")
    ).agg(F.count(F.lit(1)).alias("count"))
    return windowed.select(instants.wire_timestamp(F.col("w.start")).alias("start"), "group", "count")
