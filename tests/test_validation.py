import json

import pytest
from helpers import entry, make_envelopes
from pyspark.sql import functions as F

from timberline.operators import validation
from timberline.sources import envelopes

BAD = validation.BAD_ATTRIBUTES


def reasons(spark, entries, **kw):
    rows = validation.validate_envelopes(make_envelopes(spark, [{"logs": entries}], **kw)).collect()
    assert sorted(r["idx"] for r in rows) == list(range(len(entries)))
    return [r["reason"] for r in sorted(rows, key=lambda r: r["idx"])]


def test_golden_reasons(spark):
    cases = [
        (entry(), None),
        (entry(level="critical"), "invalid level: 'critical'"),
        (entry(attributes={"nested": {"no": True}}), BAD),
        (entry(timestamp="2026-07-20T14:05:00.000Z"), None),
        (entry(timestamp="2026-07-20T14:05:00.001Z"), "timestamp is more than 5 minutes in the future"),
        (entry(timestamp="2026-07-20 14:00:00Z"), "invalid timestamp: expected an ISO 8601 instant"),
        (entry(timestamp="2026-02-30T14:00:00Z"), "invalid timestamp: expected an ISO 8601 instant"),
        (entry(timestamp=...), "missing required field: timestamp"),
        (entry(service=..., message=...), "missing required field: service"),
        (entry(message=..., extra=1), "missing required field: message"),
        (entry(extra=1, level="critical"), "unknown field: extra"),
        ({**entry(), "zz": 1, "aa": 2}, "unknown field: zz"),
        (entry(timestamp=5), "timestamp has an invalid type"),
        (entry(timestamp=None), "timestamp has an invalid type"),
        (entry(level=None), "invalid level: 'null'"),
        (entry(level=5), "invalid level: '5'"),
        (entry(level=True), "invalid level: 'true'"),
        (entry(level={"a": 1}), "invalid level: '[object Object]'"),
        (entry(level=["a", 1, None]), "invalid level: 'a,1,'"),
        (entry(level=""), "invalid level: ''"),
        (entry(service=""), "service must not be empty"),
        (entry(service="s" * 256), None),
        (entry(service="s" * 257), "service is too long"),
        (entry(service="😀" * 256), None),
        (entry(service=1), "service has an invalid type"),
        (entry(service="a\u0000b"), "service contains a NUL character"),
        (entry(message=""), "message must not be empty"),
        (entry(message="m" * 16_384), None),
        (entry(message="m" * 16_385), "message is too long"),
        (entry(message=["x"]), "message has an invalid type"),
        (entry(attributes=...), None),
        (entry(attributes={}), None),
        (entry(attributes=None), BAD),
        (entry(attributes=[1]), BAD),
        (entry(attributes="x"), BAD),
        (entry(attributes={"a": None}), BAD),
        (entry(attributes={"a": [1]}), BAD),
        (entry(attributes={"": 1}), BAD),
        (entry(attributes={"k" * 256: 1}), None),
        (entry(attributes={"k" * 257: 1}), BAD),
        (entry(attributes={"a": "x\u0000"}), BAD),
        (entry(attributes={"a": "literal \\u0000"}), None),
        (entry(attributes={f"k{i}": i for i in range(200)}), None),
        (entry(attributes={"a": "x" * 65_528}), None),
        (entry(attributes={"a": "x" * 65_529}), "attributes exceed 65536 bytes"),
        (entry(attributes={"dotted.key": 1, "quote\"d": "v", "ümläut": "ß"}), None),
        (5, "entry has an invalid type"),
        (None, "entry has an invalid type"),
        ("text", "entry has an invalid type"),
        (json.dumps(entry()), "entry has an invalid type"),
        ([entry()], "entry has an invalid type"),
    ]
    found = reasons(spark, [c for c, _ in cases])
    assert [(c, r) for (c, _), r in zip(cases, found)] == cases


def test_normalised_row(spark):
    body = (
        '{"logs":[{"timestamp":"2026-07-20T15:00:00.1239+01:00","level":"warn","service":"s","message":"m",'
        '"attributes":{"b":1e21,"a":"x","a":"last","n":3.0,"f":false,"q\\"":"1"}}]}'
    )
    row = validation.validate_envelopes(make_envelopes(spark, [body])).first()
    assert row["reason"] is None
    assert row["attributes"] == '{"a":"last","b":1e+21,"f":false,"n":3,"q\\"":"1"}'
    assert row["attr"] == {"a": "last", "b": "1" + "0" * 21, "n": "3", "f": "false", 'q"': "1"}
    assert row["timestamp"].microsecond == 123_000
    assert row["id"][14] == "7" and row["id"][19] in "89ab"


def test_infinite_number_is_refused(spark):
    body = '{"logs":[%s]}' % json.dumps(entry(attributes={"a": 0})).replace('{"a": 0}', '{"a":1e400}')
    assert validation.validate_envelopes(make_envelopes(spark, [body])).first()["reason"] == BAD


def test_text_that_reads_infinity_is_kept(spark):
    row = validation.validate_envelopes(
        make_envelopes(spark, [{"logs": [entry(attributes={"a": "Infinity", "b": 1e300})]}])
    ).first()
    assert row["reason"] is None and row["attr"]["a"] == "Infinity"


@pytest.mark.parametrize("padding", ["", " \n"])
def test_malformed_bodies(spark, padding):
    good = ['{"logs":[]}', '{"logs":[{"a":1,"a":2}]}', '{"x":1,"logs":[1]}']
    wrong_shape = ["5", "null", "[1]", '"x"', "{}", '{"logs":null}', '{"logs":{}}', '{"logs":"[1]"}', '{"logs":5}']
    malformed = [
        "{", "", '{"logs":[]} x', '{"logs":[]}}', '{"logs":[]},0]', '{"logs":[]}, {"a":1}', '{"logs":[],}',
        '{"logs":[01]}', '{"logs":[NaN]}', '{"logs":[Infinity]}', '{"logs":[+1]}', '{"logs":[.5]}', "{'logs':[]}",
        '{"logs":["a\tb"]}', '{"logs":[]} //c', '{"logs":[]}],["x"', '1,"x"], [2', '{"logs":[]} {"logs":[]}',
    ]
    bodies = [padding + b + padding for b in good + wrong_shape + malformed]
    rows = envelopes.check_envelope(make_envelopes(spark, bodies)).collect()
    found = {r["body"]: r["envelope_error"] for r in rows}
    expected = [None] * len(good) + [envelopes.NOT_AN_ENVELOPE] * len(wrong_shape) + [envelopes.MALFORMED] * len(malformed)
    assert [found[b] for b in bodies] == expected


def test_entry_limit(spark):
    bodies = [{"logs": [1] * 2_000}, {"logs": [1] * 2_001}]
    rows = envelopes.check_envelope(make_envelopes(spark, bodies)).orderBy("batch_id").collect()
    assert [r["envelope_error"] for r in rows] == [None, "logs must contain at most 2000 entries"]


def test_batch_summary_counts_every_entry_once(spark):
    bodies = [
        {"logs": [entry(), entry(level="x"), entry()]}, {"logs": []}, {"logs": [entry(service="")]}, "{", "{}",
        {"logs": [1] * 2_001},
    ]
    summary = validation.batch_summary(validation.validate_envelopes(make_envelopes(spark, bodies)))
    rows = {r["batch_id"]: r for r in summary.collect()}
    assert [(rows[f"b{i}"]["outcome"], rows[f"b{i}"]["accepted"], rows[f"b{i}"]["rejected_count"]) for i in range(6)] == [
        ("ok", 2, 1), ("all_invalid", 0, 0), ("all_invalid", 0, 1), ("malformed", 0, 0), ("bad_envelope", 0, 0),
        ("bad_envelope", 0, 0),
    ]
    assert [tuple(r) for r in rows["b0"]["rejected"]] == [(1, "invalid level: 'x'")]
    text = '{"enabled":true,"region":"eu","retries":3}'
    assert rows["b0"]["normalized_bytes"] == 2 * (36 + 24 + len("info") + len("checkout") + len("ok") + len(text))


def test_copies_of_a_batch_are_batches_of_their_own(spark):
    env = make_envelopes(spark, [{"logs": [entry(), entry(level="x")]}])
    copies = env.unionByName(env).unionByName(env)
    rows = validation.batch_summary(validation.validate_envelopes(copies)).collect()
    assert [(r["accepted"], [x["idx"] for x in r["rejected"]]) for r in rows] == [(1, [1])] * 3


def test_ids_ascend_in_a_batch_and_repeat_on_retry(spark):
    env = make_envelopes(spark, [{"logs": [entry() for _ in range(50)]}])
    def run():
        return [r["id"] for r in validation.validate_envelopes(env).orderBy("idx").collect()]
    first = run()
    assert first == sorted(set(first)) and first == run()


def test_predicate_stays_above_the_derivation(spark):
    env = make_envelopes(spark, [{"logs": [entry()]}])
    rejected = validation.split_valid(validation.validate_envelopes(env))[1]
    plan = rejected._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("isnotnull(reason") < plan.index("Generate inline")


def test_constraint_audit(spark):
    rows = [
        ("a", 1, "info", "s", "m", "{}"), ("a", 1, "info", "s", "m", "{}"), ("a", 1, "fatal", "", None, "[]"),
        (None, None, None, None, "", "x"),
    ]
    logs = spark.createDataFrame(
        rows, "id string, ms bigint, level string, service string, message string, attributes string"
    ).withColumn("timestamp", F.timestamp_millis("ms"))
    found = {r["rule"]: r["violations"] for r in validation.constraint_audit(logs).collect()}
    assert found == {
        "id_not_null": 1, "timestamp_not_null": 1, "level_not_null": 1, "service_not_null": 1,
        "message_not_null": 1, "attributes_not_null": 0, "level_known": 1, "service_not_empty": 1,
        "message_not_empty": 1, "attributes_object": 2, "key_unique": 2,
    }
