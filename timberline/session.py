"""Session settings and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.sources import storage

# Scratch folders by application.
_SCRATCH: dict[str, list[str]] = {}

# Runtime SQL settings every operator relies on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Parsing costs far more than its bytes suggest: keep small inputs on all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A repeated JSON key keeps its last value instead of voiding the document.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings that only count when the session is created.
STATIC_CONF = {
    # Recording a Python call site for every column expression dominates the cost of building them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build(app: str = "timberline", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a machine-local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard_scratch(spark: SparkSession) -> int:
    """Remove the scratch folders this session has made so far, once the results derived from them are not needed any more."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        storage.remove(spark, path)
    return len(paths)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to shared storage and read back: survives executor loss and is never re-derived."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def on_all_cores(df: DataFrame) -> DataFrame:
    """Spread the rows of an input with fewer partitions than cores, before costly work on each row.

    A large table has more partitions than that and is left as it is, without a shuffle; so is a frame that is shuffled
    already.
    """
    cores, planned = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if "Exchange" in planned.executedPlan().toString() or planned.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


# Bytes of texts in a broadcast table.
MAX_BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when the frame holds at most so many rows, and so many bytes of texts; summed per task, no rows are gathered."""
    wide = [name for name, kind in df.dtypes if kind not in _FIXED]
    text = sum((F.coalesce(F.octet_length(_as_text(df, name)), F.lit(0)) for name in wide), F.lit(0)).cast("bigint")
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= max_rows and found["bytes"] <= max_bytes


_FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}


def _as_text(df: DataFrame, name: str):
    kind = dict(df.dtypes)[name]
    return F.to_json(name) if kind.startswith(("array", "map", "struct")) else F.col(name)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast behind a check of rows and bytes; otherwise leave the join strategy to the planner."""
    return F.broadcast(df) if fits(df, max_rows) else df
