import hashlib
import json
import random
import struct
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelake.functions import codec, hlc
from tests.model import clock_key

ODD = ["", "5/01", "5/1", "99/x", "100/x", "7", "/ff", "abc/1", "18446744073709551616/1", "3/" + "f" * 32, "3/1" + "f" * 32, "4/1/2", "+6/+A", " 5/1", "5/ 1", "00000000000000000000000005/1", "5/" + "0" * 40 + "a", None]


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_key_orders_like_numbers(spark):
    rng = random.Random(1)
    clocks = ODD + [f"{rng.choice([rng.randrange(200), rng.randrange(1 << 64)])}/{rng.choice([rng.randrange(300), rng.randrange(1 << 128)]):x}" for _ in range(500)]
    keys = column(spark, clocks, hlc.hlc_key("v"))
    for h, key in zip(clocks, keys):
        assert key is None if h is None else (int(key[:20]), int(key[20:], 16)) == clock_key(h), h


def test_newer_is_strict_and_numeric(spark):
    rows = spark.createDataFrame([("100/x", "99/x"), ("5/01", "5/1"), ("5/10", "5/02"), ("", "0/0")], "a string, b string")
    assert [r[0] for r in rows.select(hlc.is_newer("a", "b")).collect()] == [True, False, True, False]
    assert [r[0] for r in rows.select(hlc.hlc_compare("b", "a")).collect()] == [-1, 0, -1, 0]


def test_nodes(spark):
    device = str(uuid.UUID(int=0x0123456789ABCDEF0011223344556677))
    want = f"{int.from_bytes(uuid.UUID(device).bytes, 'little'):032x}"
    assert column(spark, [device, device.upper(), "no"], hlc.node_of_uuid("v")) == [want, want, None]
    assert column(spark, ["5/00A", "5/b", "5", "5/", "5/xyz"], hlc.is_from_node("v", F.lit("a".rjust(32, "0")))) == [True, False, False, False, False]
    assert column(spark, ["5/a/b", "5"], hlc.node_suffix("v")) == ["a/b", None]


def test_drift_and_completeness(spark):
    now = 1000 << 32
    got = column(spark, [f"{(1000 + 7) << 32}/a", f"{900 << 32}/a", "5", "5/0a", "18446744073709551615/1"], hlc.drift_seconds("v", now))
    assert got[0] == pytest.approx(7, abs=1e-6) and got[1:4] == [None, None, None] and got[4] > 1e9
    assert column(spark, ["0005/a", "5/0", "5/0a", "5/A", "/a", "18446744073709551616/1"], hlc.is_complete("v")) == [True, False, False, False, False, False]


def test_cutoff():
    day = hlc.NANOSECONDS_PER_DAY
    assert hlc.retention_cutoff(100 * day, 30) == 70 * day
    assert hlc.retention_cutoff(5, 30) == 0 and hlc.retention_cutoff(None, 1) is None and hlc.retention_cutoff((1 << 64) - 1, 0) is None


def test_values_round_trip(spark):
    cases = [(T.StringType(), "string", ['a"b\\\n', "", "null", '{"$blob_hex":"00"}', "é", None]), (T.LongType(), "long", [0, -(1 << 63), (1 << 63) - 1, None]), (T.BinaryType(), "binary", [b"", b"\x00\xff", None]), (T.DoubleType(), "double", [0.5, -1e21, None]), (T.BooleanType(), "boolean", [True, False, None])]
    for kind, name, values in cases:
        rows = spark.createDataFrame([(v,) for v in values], f"v {name}")
        text = codec.encode_value("v", kind)
        got = [tuple(r) for r in rows.select("v", text, codec.decode_value(text, kind)).collect()]
        for v, encoded, back in got:
            json.loads(encoded)
            assert back == v
    assert column(spark, [float("nan"), float("inf")], codec.encode_value("v", T.DoubleType()), "double") == ["0", "0"]
    assert column(spark, ['{"$blob_hex":"0g"}', '{"$blob_hex":"0"}', '"00"', '{"$blob_hex":"00","x":1}'], codec.decode_value(F.col("v"), T.BinaryType())) == [None] * 4
    assert column(spark, ["true", "false", "7", '"x"'], codec.decode_value(F.col("v"), T.LongType())) == [1, 0, 7, None]
    assert column(spark, ['{"a":1}', "[1, 2]"], codec.decode_value(F.col("v"), T.StringType())) == ['{"a":1}', "[1, 2]"]


def test_canonical_pk(spark):
    keys = [("b", T.StringType()), ("a", T.LongType())]
    texts = ['{"a":1,"b":"x"}', ' {"b" : "x", "a":1}', '{"b":"x"}', '{"a":1,"b":"x","c":2}', "[1]", "no", '{"a":"x","b":"x"}', '{"a":null,"b":null}', None]
    assert column(spark, texts, codec.canonical_pk(F.col("v"), keys)) == ['{"b":"x","a":1}'] * 2 + [None] * 5 + ['{"b":null,"a":null}', None]
    blob = [("k", T.BinaryType())]
    assert column(spark, ['{"k":{"$blob_hex":"00ff"}}', '{"k":{"$blob_hex":"0"}}'], codec.canonical_pk(F.col("v"), blob)) == ['{"k":{"$blob_hex":"00ff"}}', None]


def test_preimages(spark):
    parts = ["t", '{"k":{"$blob_hex":"00ff"}}', "c", "5/a"]

    def want(pks, value):
        return b"".join(struct.pack(">I", len(p.encode())) + p.encode() for p in ["t", pks, "c", "5/a", value])

    args = [F.lit(p) for p in parts]
    got = column(spark, ['{"b":[{"y":1,"x":"é"}],"a":null}', "7", '{"$blob_hex":"00ff"}'], F.struct(codec.preimage(*args, F.col("v")), codec.legacy_preimage(*args, F.col("v"))))
    old = '{"k":"AP8="}'
    assert [bytes(g[0]) for g in got] == [want(parts[1], '{"a":null,"b":[{"x":"é","y":1}]}'), want(parts[1], "7"), want(parts[1], '{"$blob_hex":"00ff"}')]
    assert [bytes(g[1]) for g in got] == [want(old, '{"a":null,"b":[{"x":"é","y":1}]}'), want(old, "7"), want(old, '"AP8="')]
    plain = column(spark, ["7"], codec.legacy_preimage(F.lit("t"), F.lit("{}"), F.lit("c"), F.lit("5/a"), F.col("v")))
    assert plain == [None]
    assert hashlib.sha256(want("{}", "7")).hexdigest() == column(spark, ["7"], F.sha2(codec.scalar_preimage(F.lit("t"), F.lit("{}"), F.lit("c"), F.lit("5/a"), F.col("v")), 256))[0]


def test_wire_records(spark):
    rows = spark.createDataFrame([("t", '{"k":1}', "c", "5/a", '"x"', "d", None), ("t", '{"k":"\\""}', "c", "5/a", "null", "", '{"by":1}')], "table_name string, row_pks string, column_name string, hlc_timestamp string, value string, device_id string, sig string")
    texts = [r[0] for r in rows.select(codec.change_json()).collect()]
    assert json.loads(texts[0]) == {"tableName": "t", "rowPks": '{"k":1}', "columnName": "c", "hlcTimestamp": "5/a", "value": "x", "deviceId": "d"}
    assert json.loads(texts[1])["value"] is None and json.loads(texts[1])["sig"] == {"by": 1}
    back = spark.createDataFrame([(t,) for t in texts], "v string").select(codec.parse_change(F.col("v")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in rows.collect()]
