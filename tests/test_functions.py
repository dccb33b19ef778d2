import pytest
from pyspark.sql import functions as F

from timberline.functions import attributes, instants


def test_strict_instants_in_any_zone(spark, zones):
    cases = {
        "2026-07-20T14:05:00.000Z": "2026-07-20T14:05:00.000Z",
        "2024-02-29T23:59:59.123999999+20:00": "2024-02-29T03:59:59.123Z",
        "2024-01-01T00:00:00-05:30": "2024-01-01T05:30:00.000Z",
        "1969-12-31T23:59:59.9Z": "1969-12-31T23:59:59.900Z",
        "2024-03-10T02:30:00Z": "2024-03-10T02:30:00.000Z",
        "2026-07-20 14:00:00Z": None,
        "2024-02-30T00:00:00Z": None,
        "2023-02-29T00:00:00Z": None,
        "2024-13-01T00:00:00Z": None,
        "2024-01-01T24:00:00Z": None,
        "2024-01-01T00:60:00Z": None,
        "2024-01-01T00:00:60Z": None,
        "2024-01-01T00:00:00": None,
        "2024-01-01T00:00:00.Z": None,
        "2024-01-01T00:00:00.1234567890Z": None,
        "2024-01-01T00:00:00+24:00": None,
        "2024-01-01T00:00:00+05:60": None,
        "2024-01-01T00:00:00Z\n": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")

    def check():
        rows = df.select("t", instants.wire(instants.instant_millis(F.col("t"))).alias("w")).collect()
        assert {r["t"]: r["w"] for r in rows} == cases

    zones(check)


def test_buckets_dates_and_seconds_floor_before_1970(spark, zones):
    df = spark.createDataFrame([(-1,), (0,), (86_399_999,), (-86_400_001,)], "ms bigint")

    def check():
        rows = df.select(
            instants.bucket_millis(F.col("ms"), "5m").alias("b"),
            instants.second_of(F.col("ms")).alias("s"),
            instants.event_date(instants.from_millis(F.col("ms"))).cast("string").alias("d"),
        ).collect()
        assert [tuple(r) for r in rows] == [
            (-300_000, -1, "1969-12-31"), (0, 0, "1970-01-01"),
            (86_100_000, 86_399, "1970-01-01"), (-86_700_000, -86_401, "1969-12-30"),
        ]

    zones(check)


def test_number_texts(spark):
    cases = {  # JSON text: (wire text, comparison text)
        "3": ("3", "3"), "3.0": ("3", "3"), "-0": ("0", "0"), "-0.0": ("0", "0"), "-0.5": ("-0.5", "-0.5"),
        "1e21": ("1e+21", "1" + "0" * 21), "1e-7": ("1e-7", "0.0000001"), "0.000001": ("0.000001", "0.000001"),
        "123456789.25": ("123456789.25", "123456789.25"), "9007199254740993": ("9007199254740992",) * 2,
        "0.1": ("0.1", "0.1"), "1.10": ("1.1", "1.1"), "12.5e10": ("125000000000",) * 2,
        "2e23": ("2e+23", "2" + "0" * 23), "0.30000000000000004": ("0.30000000000000004",) * 2,
        "1.23e-5": ("0.0000123", "0.0000123"), "-1.5e-10": ("-1.5e-10", "-0.00000000015"),
        "123456789012345680000": ("123456789012345680000",) * 2, "1e2": ("100", "100"),
        "12345678901234567890": ("12345678901234567000",) * 2, "0.1234567890123456": ("0.1234567890123456",) * 2,
    }
    df = spark.createDataFrame([(k, f'{{"a":{k}}}') for k in cases], "raw string, doc string")
    bag = attributes.attribute_entries(attributes.object_fields(F.parse_json("doc")))
    rows = df.select("raw", bag[0]["text"].alias("t")).collect()
    assert {r["raw"]: (r["t"]["json"], r["t"]["plain"]) for r in rows} == cases


def test_preview_orders_short_keys_first(spark):
    df = spark.createDataFrame(
        [({"zeta": "1", "b": "2", "aa": "3"},), ({},), ({"k": "v"},)], "attr map<string,string>"
    )
    text, more = attributes.preview(F.col("attr"))
    assert [tuple(r) for r in df.select(text, more).collect()] == [("b=2", 2), (None, 0), ("k=v", 0)]


@pytest.mark.parametrize("text", ["2024-01-01", "2024-01-01 00:00:00", "20240101T00", "2024-W01-1", "2024-01-01T00:00:00"])
def test_driver_instants_are_strict(text):
    with pytest.raises(ValueError):
        instants.to_millis(text)
