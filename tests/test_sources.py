import struct

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import avro, specs, wire
from lodestrata.sources.registry import SchemaRegistry

PAYMENT = {"type": "record", "name": "P", "fields": [{"name": "id", "type": "string"}, {"name": "cents", "type": "int"}]}


def text(s):
    return avro_long(len(s.encode())) + s.encode()


def avro_long(n):
    z, out = (n << 1) ^ (n >> 63), b""
    while z > 127:
        out, z = out + bytes([z & 127 | 128]), z >> 7
    return out + bytes([z])


def framed(i, payload):
    return b"\0" + struct.pack(">I", i) + payload


def test_routing_loses_no_row(spark):
    raw = spark.createDataFrame([(framed(7, text("a") + avro_long(5)),), (b"\xff\0\0\0\7abc",), (framed(999, b"x"),), (b"\0\0",), (None,), (b"",)], "value binary").select("value", F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"))
    found = sorted(str(r.quarantine_reason) for r in wire.routed(raw, [7]).collect())
    assert found == ["None", "invalid_wire_format", "invalid_wire_format", "invalid_wire_format", "null_value", "unknown_schema_id"]
    assert wire.routed(raw, []).where("quarantine_reason is null").count() == 0


def test_decoding_by_writer_schema(spark):
    newer = {**PAYMENT, "fields": [*PAYMENT["fields"], {"name": "note", "type": ["null", "string"], "default": None}]}
    rows = spark.createDataFrame([(1, text("a") + avro_long(-3)), (2, text("b") + avro_long(9) + avro_long(1) + text("hi")), (1, b"\xff"), (5, text("c")), (1, None)], "schema_id long, payload binary")
    got = [tuple(r.decoded) if r.decoded else None for r in avro.decoded(rows, newer, {1: PAYMENT, 2: newer}).select("decoded").collect()]
    assert got == [("a", -3, None), ("b", 9, "hi"), None, None, None]


def test_all_types():
    schema = {"type": "record", "name": "R", "fields": [{"name": "b", "type": "boolean"}, {"name": "f", "type": "float"}, {"name": "d", "type": "double"}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["X", "Y"]}}, {"name": "a", "type": {"type": "array", "items": "long"}}, {"name": "m", "type": {"type": "map", "values": "int"}}, {"name": "day", "type": {"type": "int", "logicalType": "date"}}, {"name": "x", "type": {"type": "fixed", "name": "F", "size": 2}}]}
    data = b"\1" + struct.pack("<f", 1.5) + struct.pack("<d", 2.5) + avro_long(1) + avro_long(2) + avro_long(7) + avro_long(-8) + b"\0" + avro_long(1) + text("k") + avro_long(4) + b"\0" + avro_long(1) + b"ab"
    got = avro.decode(data, schema)
    assert (got["b"], got["f"], got["d"], got["e"], got["a"], got["m"], str(got["day"]), got["x"]) == (True, 1.5, 2.5, "Y", [7, -8], {"k": 4}, "1970-01-02", b"ab")
    with pytest.raises(ValueError):
        avro.decode(data + b"x", schema)
    assert avro.spark_type(schema).simpleString() == "struct<b:boolean,f:float,d:double,e:string,a:array<bigint>,m:map<string,int>,day:date,x:binary>"


def test_compatibility():
    added = {**PAYMENT, "fields": [*PAYMENT["fields"], {"name": "n", "type": "int"}]}
    assert not avro.compatible(added, PAYMENT) and avro.compatible(PAYMENT, added)
    assert avro.compatible("long", "int") and not avro.compatible("int", "long")


def test_registry(spark, tmp_path):
    r = SchemaRegistry(spark, f"file://{tmp_path}")
    assert r.register("s", PAYMENT) == 1 and r.register("s", PAYMENT) == 1
    second = {**PAYMENT, "fields": [*PAYMENT["fields"], {"name": "n", "type": "int", "default": 0}]}
    assert r.accepts("s", second) and r.register("s", second) == 2
    assert r.ids("s") == [1, 2] and r.latest("s") == (2, second) and r.schema(1) == PAYMENT
    with pytest.raises(KeyError):
        r.schema(9)


def test_specs():
    with pytest.raises(ValueError):
        specs.source_options("h:1")
    assert specs.source_options("h:1", "PLAINTEXT")["failOnDataLoss"] == "false"
    assert specs.source_options("h:1", user="u", secret="s", starting={"t": {"0": 5}})["startingOffsets"] == '{"t": {"0": 5}}'
    assert specs.client_security("far:1", {"MESSAGE_SECURITY_PROTOCOL": "PLAINTEXT"})[1]
    with pytest.raises(ValueError):
        specs.entity_specs([{"name": "a", "source": "b", "target": "c"}])
    with pytest.raises(ValueError):
        specs.entity_specs([{"name": "a", "source": "b", "target": "c", "keys": ["k"], "history": 3}])
    with pytest.raises(NotImplementedError):
        specs.topic_specs([{"topic": "a", "subject": "b", "reader_schema": "3"}])
    assert specs.entity_specs([{"name": "a", "source": "b", "target": "c", "keys": ["k"], "quarantine": "q"}])[0].quarantine == "q"
    assert specs.setting("N", 4, int, {}) == 4 and specs.setting("N", kind=list, env={"N": "[1]"}) == [1]
    assert specs.raw_paths("s3a://x/", "raw", "t")["data"] == "s3a://x/raw/data/t"


def test_numbers_as_avro_writes_them(spark):
    for n in (0, 1, 63, 64, 8191, 8192, 1 << 20, (1 << 33)):
        assert bytes(spark.range(1).select(avro.encode_long(F.lit(n))).first()[0]) == avro_long(n)


def test_batches_decode_as_single_messages():
    import random

    import pyarrow as pa

    inner = {"type": "record", "name": "I", "fields": [{"name": "x", "type": "int"}, {"name": "y", "type": ["string", "null"]}]}
    writer = {"type": "record", "name": "R", "fields": [{"name": "a", "type": "long"}, {"name": "s", "type": "string"}, {"name": "n", "type": ["null", "double"]}, {"name": "gone", "type": inner}, {"name": "i", "type": inner}, {"name": "b", "type": "boolean"}, {"name": "f", "type": "float"}, {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["p", "q"]}}, {"name": "x", "type": {"type": "fixed", "name": "F", "size": 3}}, {"name": "raw", "type": "bytes"}]}
    keep = [f for f in writer["fields"] if f["name"] != "gone"]
    reader = {"type": "record", "name": "R", "fields": [{"name": "new", "type": "int", "default": 4}, {"name": "a", "type": "double"}, *keep[1:]]}
    r = random.Random(1)

    def message():
        record = lambda: avro_long(r.randint(-9, 9)) + (avro_long(0) + text(r.choice(["", "é", "long one"])) if r.random() < 0.5 else avro_long(1))
        n = avro_long(0) if r.random() < 0.3 else avro_long(1) + struct.pack("<d", r.random())
        return avro_long(r.choice([0, -1, 2**62, -(2**63), r.randint(-999, 999)])) + text("w" * r.randint(0, 70)) + n + record() + record() + bytes([r.randint(0, 1)]) + struct.pack("<f", 0.5) + avro_long(r.randint(0, 1)) + b"xyz" + text("raw")

    messages = [message() for _ in range(300)]
    for k in range(200):  # broken ones: cut, lengthened, one byte changed
        m = message()
        at = r.randrange(len(m))
        messages.append([m[:at], m + b"\0", m[:at] + bytes([r.randrange(256)]) + m[at + 1 :]][k % 3])
    values, ok = avro.decode_together(pa.array(messages, pa.binary()), writer, reader)
    assert ok[:300].all() and not ok.all()
    for m, value, sound in zip(messages, values.to_pylist(), ok):
        try:
            want = avro.resolve(avro.decode(m, writer), writer, reader)
        except (ValueError, KeyError, TypeError, IndexError):
            want = None
        assert sound == (want is not None) and (not sound or value == {**want, "i": {k: want["i"][k] for k in ("x", "y")}} or abs(want["i"]["x"]) >= 2**31)
    arrays = {"type": "record", "name": "A", "fields": [{"name": "v", "type": {"type": "array", "items": "long"}}]}
    values, ok = avro.decode_together(pa.array([avro_long(1) + avro_long(5) + avro_long(0), b"\2"], pa.binary()), arrays, arrays)
    assert values.to_pylist()[0] == {"v": [5]} and ok.tolist() == [True, False]


def test_the_package_reaches_the_executors(tmp_path):
    """Started in another folder, without the package on the workers' path."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent)
    script = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from lodestrata.sources import avro
s = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "512m").getOrCreate()
schema = {{"type": "record", "name": "R", "fields": [{{"name": "a", "type": "long"}}]}}
rows = s.createDataFrame([(1, bytes([10]))], "schema_id long, payload binary")
print("got", avro.decoded(rows, schema, {{1: schema}}).first().decoded.a)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "got 5" in done.stdout, done.stderr[-2000:]


def test_message_source_options(spark):
    from pyspark.errors import AnalysisException

    from lodestrata.streaming.raw import message_stream

    options = specs.source_options("broker:9092", "PLAINTEXT", most_rows=5000, least_rows=100, most_seconds=5)
    assert {k: options[k] for k in ("maxOffsetsPerTrigger", "minOffsetsPerTrigger", "maxTriggerDelay")} == {"maxOffsetsPerTrigger": "5000", "minOffsetsPerTrigger": "100", "maxTriggerDelay": "5s"}
    with pytest.raises(AnalysisException, match="(?i)kafka"):  # the connector isn't on this class path
        message_stream(spark, options, "t")
