"""Container resource samples written as CSV text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import instants
from timberline.schema import RAW_RESOURCE_SAMPLES

# Bytes per memory unit.
UNIT_BYTES = {
    "B": 1, "kB": 10**3, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12,
    "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40,
}
_AMOUNT = r"^\s*([0-9.]+)\s*([A-Za-z]+)\s*$"


def read_resource_samples(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(RAW_RESOURCE_SAMPLES).option("header", True).csv(path)
    return parse_resource_samples(raw)


def parse_resource_samples(raw: DataFrame) -> DataFrame:
    """Typed samples: percentages as numbers, memory as used and limit bytes."""
    usage = F.split("memory_usage", "/")
    return raw.select(
        instants.from_millis(instants.instant_millis(F.col("timestamp"))).alias("timestamp"),
        "container",
        percent(F.col("cpu_percent")).alias("cpu_percent"),
        to_bytes(F.get(usage, F.lit(0))).alias("memory_bytes"),
        to_bytes(F.get(usage, F.lit(1))).alias("memory_limit_bytes"),
        percent(F.col("memory_percent")).alias("memory_percent"),
    )


def percent(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([0-9.]+)\s*%\s*$", 1).try_cast("double")


def to_bytes(text: Column) -> Column:
    unit = F.lit(None).cast("double")
    for name, size in UNIT_BYTES.items():
        unit = F.when(F.regexp_extract(text, _AMOUNT, 2) == name, F.lit(float(size))).otherwise(unit)
    return F.regexp_extract(text, _AMOUNT, 1).try_cast("double") * unit
