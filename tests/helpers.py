import json

from pyspark.sql import functions as F

from timberline.functions import instants

ATTR = "map<string,string>"


def make_logs(spark, rows):
    """``rows`` of (id number, instant, level, service, message, attr)."""
    data = [
        (f"00000000-0000-7000-8000-{n:012x}", instants.to_millis(at), level, service, message, attr)
        for n, at, level, service, message, attr in rows
    ]
    df = spark.createDataFrame(
        data, f"id string, ms bigint, level string, service string, message string, attr {ATTR}"
    )
    return df.select(
        "id", instants.from_millis(F.col("ms")).alias("timestamp"), "level", "service", "message",
        F.to_json("attr").alias("attributes"), "attr",
    )


def make_envelopes(spark, bodies, at="2026-07-20T14:00:00.000Z"):
    """One envelope per body; anything but text is written as JSON."""
    rows = [
        (f"b{i}", instants.to_millis(at), body if isinstance(body, str) else json.dumps(body, ensure_ascii=False))
        for i, body in enumerate(bodies)
    ]
    df = spark.createDataFrame(rows, "batch_id string, ms bigint, body string")
    return df.select("batch_id", instants.from_millis(F.col("ms")).alias("received_at"), "body")


def entry(**changes):
    base = {
        "timestamp": "2026-07-20T14:00:00.000Z", "level": "info", "service": "checkout", "message": "ok",
        "attributes": {"retries": 3, "enabled": True, "region": "eu"},
    }
    base.update(changes)
    return {k: v for k, v in base.items() if v is not ...}


def plan_text(df, mode="formatted"):
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
