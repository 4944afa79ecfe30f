"""Avro binary decoding under a writer's schema, resolved to a reader's schema.

Used where Spark's own Avro module isn't on the class path. Rows that can't be
decoded give null, so they can be quarantined. A batch's payloads of one writer are
decoded together, field after field, over the Arrow buffer that holds them; schemas
with arrays, maps, decimals or unions of several types are read datum by datum.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from lodestrata.session import ship

_SIMPLE = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "null": T.NullType()}
_LOGICAL = {"date": T.DateType(), "timestamp-millis": T.TimestampType(), "timestamp-micros": T.TimestampType()}
_WIDER = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",), "string": ("bytes",), "bytes": ("string",)}
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def parse(schema: str | dict | list) -> dict | list | str:
    return json.loads(schema) if isinstance(schema, str) and schema.strip()[:1] in '{["' else schema


def _branches(schema) -> list:
    return schema if isinstance(schema, list) else [schema]


def _kind(schema) -> str:
    return schema["type"] if isinstance(schema, dict) else schema


def spark_type(schema) -> T.DataType:
    """The Spark type of an Avro schema. Unions with null are nullable; other
    unions of several types aren't supported."""
    schema = parse(schema)
    if isinstance(schema, list):
        rest = [x for x in schema if x != "null"]
        if len(rest) != 1:
            raise ValueError(f"union of {len(rest)} types")
        return spark_type(rest[0])
    kind = _kind(schema)
    if isinstance(schema, dict):
        logical = schema.get("logicalType")
        if logical in _LOGICAL:
            return _LOGICAL[logical]
        if logical == "decimal":
            return T.DecimalType(schema["precision"], schema.get("scale", 0))
        if kind == "record":
            return T.StructType([T.StructField(f["name"], spark_type(f["type"])) for f in schema["fields"]])
        if kind == "array":
            return T.ArrayType(spark_type(schema["items"]))
        if kind == "map":
            return T.MapType(T.StringType(), spark_type(schema["values"]))
        if kind == "enum":
            return T.StringType()
        if kind == "fixed":
            return T.BinaryType()
        if isinstance(kind, (dict, list)):
            return spark_type(kind)
    if kind not in _SIMPLE:
        raise ValueError(f"unknown Avro type {kind}")
    return _SIMPLE[kind]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("payload ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        shift = out = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 0x7F) << shift
            if not b & 0x80:
                return (out >> 1) ^ -(out & 1)
            shift += 7
            if shift > 63:
                raise ValueError("number too long")

    def blocks(self):
        while n := self.number():
            if n < 0:
                self.number()
                n = -n
            yield from range(n)

    def value(self, schema):
        if isinstance(schema, list):
            return self.value(schema[self.number()])
        kind = _kind(schema)
        if isinstance(kind, (dict, list)):
            return self.value(kind)
        match kind:
            case "null":
                return None
            case "boolean":
                return self.take(1) != b"\0"
            case "int" | "long":
                raw = self.number()
            case "float":
                return struct.unpack("<f", self.take(4))[0]
            case "double":
                return struct.unpack("<d", self.take(8))[0]
            case "bytes":
                raw = self.take(self.number())
            case "string":
                return self.take(self.number()).decode()
            case "fixed":
                raw = self.take(schema["size"])
            case "enum":
                return schema["symbols"][self.number()]
            case "array":
                return [self.value(schema["items"]) for _ in self.blocks()]
            case "map":
                return {self.take(self.number()).decode(): self.value(schema["values"]) for _ in self.blocks()}
            case "record":
                return {f["name"]: self.value(f["type"]) for f in schema["fields"]}
            case _:
                raise ValueError(f"unknown Avro type {kind}")
        match schema.get("logicalType") if isinstance(schema, dict) else None:
            case "date":
                return dt.date(1970, 1, 1) + dt.timedelta(days=raw)
            case "timestamp-millis":
                return _EPOCH + dt.timedelta(milliseconds=raw)
            case "timestamp-micros":
                return _EPOCH + dt.timedelta(microseconds=raw)
            case "decimal":
                return Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-schema.get("scale", 0))
        return raw


def decode(data: bytes, writer) -> object:
    """The value of one datum; ValueError if bytes are missing or left over."""
    reader = _Reader(data)
    out = reader.value(parse(writer))
    if reader.at != len(data):
        raise ValueError("bytes are left over")
    return out


def resolve(value, writer, reader):
    """A record's value as the reader's schema has it: fields by name, defaults for
    those the writer lacks, numbers widened."""
    writer, reader = parse(writer), parse(reader)
    if isinstance(reader, dict) and reader.get("type") == "record" and isinstance(value, dict):
        known = {f["name"]: f["type"] for f in writer["fields"]} if isinstance(writer, dict) else {}
        out = {}
        for f in reader["fields"]:
            if f["name"] in known:
                out[f["name"]] = resolve(value[f["name"]], known[f["name"]], f["type"])
            elif "default" in f:
                out[f["name"]] = f["default"]
            else:
                raise ValueError(f"field {f['name']} has no value and no default")
        return out
    target = [x for x in _branches(reader) if x != "null"]
    if len(target) == 1 and _kind(target[0]) in ("float", "double") and isinstance(value, int):
        return float(value)
    return value


def compatible(reader, writer) -> bool:
    """Whether data written under `writer` can be read under `reader`."""
    reader, writer = parse(reader), parse(writer)
    if isinstance(writer, list):
        return all(compatible(reader, x) for x in writer)
    if isinstance(reader, list):
        return any(compatible(x, writer) for x in reader)
    r, w = _kind(reader), _kind(writer)
    if r != w:
        return r in _WIDER.get(w, ())
    if r == "record":
        known = {f["name"]: f["type"] for f in writer["fields"]}
        return all(compatible(f["type"], known[f["name"]]) if f["name"] in known else "default" in f for f in reader["fields"])
    if r == "array":
        return compatible(reader["items"], writer["items"])
    if r == "map":
        return compatible(reader["values"], writer["values"])
    if r == "enum":
        return set(writer["symbols"]) <= set(reader["symbols"])
    return r != "fixed" or reader["size"] == writer["size"]


class _NotVectorised(Exception):
    """The schema has parts that are read datum by datum."""


def arrow_type(schema) -> pa.DataType:
    """The Arrow type of a reader's schema, as spark_type has it."""
    schema = parse(schema)
    if isinstance(schema, list):
        return arrow_type([x for x in schema if x != "null"][0])
    kind = _kind(schema)
    if isinstance(schema, dict):
        logical = schema.get("logicalType")
        if logical == "date":
            return pa.date32()
        if logical in _LOGICAL:
            return pa.timestamp("us", "UTC")
        if logical == "decimal":
            return pa.decimal128(schema["precision"], schema.get("scale", 0))
        if kind == "record":
            return pa.struct([(f["name"], arrow_type(f["type"])) for f in schema["fields"]])
        if kind == "array":
            return pa.list_(arrow_type(schema["items"]))
        if kind == "map":
            return pa.map_(pa.string(), arrow_type(schema["values"]))
        if isinstance(kind, (dict, list)):
            return arrow_type(kind)
    simple = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "bytes": pa.binary(), "fixed": pa.binary(), "string": pa.string(), "enum": pa.string(), "null": pa.null()}
    return simple[kind]


class _Batch:
    """Payloads in one buffer, where each is read next, where each ends, and which are sound."""

    def __init__(self, payloads: pa.Array):
        payloads = payloads.cast(pa.large_binary())
        offsets = np.frombuffer(payloads.buffers()[1], np.int64)[payloads.offset : payloads.offset + len(payloads) + 1]
        self.data = np.frombuffer(payloads.buffers()[2] or b"\0", np.uint8)
        self.at, self.end = offsets[:-1].copy(), offsets[1:].copy()
        self.ok = np.ones(len(payloads), bool)

    def take(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where `sizes` bytes of each row begin, and the sizes; rows that end before lose theirs."""
        bad = (sizes < 0) | (sizes > self.end[rows] - self.at[rows])
        self.ok[rows[bad]] = False
        sizes = np.where(self.ok[rows], sizes, 0)
        begin = self.at[rows].copy()
        self.at[rows] += sizes
        return begin, sizes

    def numbers(self, rows: np.ndarray) -> np.ndarray:
        out, active = np.zeros(len(rows), np.uint64), np.flatnonzero(self.ok[rows])
        for k in range(10):
            here = rows[active]
            inside = self.at[here] < self.end[here]
            self.ok[here[~inside]] = False
            active, here = active[inside], here[inside]
            if not len(active):
                break
            byte = self.data[self.at[here]].astype(np.uint64)
            self.at[here] += 1
            out[active] |= (byte & np.uint64(127)) << np.uint64(7 * k)
            active = active[byte >= 128]
        self.ok[rows[active]] = False
        return (out >> np.uint64(1)).astype(np.int64) ^ -(out & np.uint64(1)).astype(np.int64)

    def fixed(self, rows: np.ndarray, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        begin, sizes = self.take(rows, np.full(len(rows), size))
        places = np.minimum(begin[:, None] + np.arange(size), len(self.data) - 1)
        return np.where(sizes > 0, np.ascontiguousarray(self.data[places]).view(kind)[:, 0], 0)

    def strings(self, rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
        begin, sizes = self.take(rows, sizes)
        ends = np.cumsum(sizes)
        places = np.repeat(begin - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[places]))])

    def text(self, rows: np.ndarray, raw: pa.Array) -> pa.Array:
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:  # some aren't UTF-8
            out = []
            for row, value in zip(rows, raw.to_pylist()):
                try:
                    out.append(value.decode())
                except UnicodeDecodeError:
                    self.ok[row] = False
                    out.append(None)
            return pa.array(out, pa.large_string())

    def read(self, rows: np.ndarray, writer, reader) -> pa.Array:
        """The rows' next values, as the reader has them (reader None: anything)."""
        kind = pa.null() if reader is None else arrow_type(reader)
        if isinstance(writer, list):
            if sum(x != "null" for x in writer) > 1:
                raise _NotVectorised
            branch = self.numbers(rows)
            self.ok[rows[(branch < 0) | (branch >= len(writer))]] = False
            some = np.flatnonzero([x != "null" for x in writer])
            place = np.full(len(rows), -1)
            out = pa.array([], kind)
            if len(some):
                chosen = np.flatnonzero(self.ok[rows] & (branch == some[0]))
                place[chosen] = np.arange(len(chosen))
                out = self.read(rows[chosen], writer[some[0]], reader)
            return out.take(pa.array(place, mask=place < 0)) if len(out) else pa.nulls(len(rows), kind)
        name, target = _kind(writer), None if reader is None else [x for x in _branches(parse(reader)) if x != "null"][0]
        if isinstance(name, (dict, list)):
            return self.read(rows, name, reader)
        if name == "record":
            known = {f["name"]: f["type"] for f in target["fields"]} if isinstance(target, dict) else {}
            found = {f["name"]: self.read(rows, f["type"], known.get(f["name"])) for f in writer["fields"]}
            if reader is None:
                return pa.nulls(len(rows))
            columns = []
            for f in target["fields"]:
                of = arrow_type(f["type"])
                if f["name"] not in found and "default" not in f:
                    self.ok[rows] = False
                columns.append(found[f["name"]] if f["name"] in found else pa.array([f.get("default")] * len(rows), of))
            return pa.StructArray.from_arrays(columns, fields=[pa.field(f["name"], c.type) for f, c in zip(target["fields"], columns)]) if columns else pa.nulls(len(rows), kind)
        logical = writer.get("logicalType") if isinstance(writer, dict) else None
        if name in ("array", "map") or logical == "decimal":
            raise _NotVectorised
        if name == "null":
            return pa.nulls(len(rows), kind)
        if name == "boolean":
            out = pa.array(self.fixed(rows, "u1") != 0)
        elif name in ("int", "long"):
            raw = self.numbers(rows)
            out = pa.array(raw.astype(np.int32), pa.date32()) if logical == "date" else pa.array(raw * 1000, pa.timestamp("us", "UTC")) if logical == "timestamp-millis" else pa.array(raw, pa.timestamp("us", "UTC")) if logical == "timestamp-micros" else pa.array(raw)
        elif name in ("float", "double"):
            out = pa.array(self.fixed(rows, "<f4" if name == "float" else "<f8"))
        elif name == "enum":
            raw = self.numbers(rows)
            wrong = (raw < 0) | (raw >= len(writer["symbols"]))
            self.ok[rows[wrong]] = False
            out = pa.array(writer["symbols"], pa.string()).take(pa.array(np.where(wrong, 0, raw)))
        elif name in ("string", "bytes", "fixed"):
            out = self.strings(rows, np.full(len(rows), writer["size"]) if name == "fixed" else self.numbers(rows))
            if name == "string":
                out = self.text(rows, out)
        else:
            raise ValueError(f"unknown Avro type {name}")
        if reader is None:
            return pa.nulls(len(rows))
        if pa.types.is_string(kind) and pa.types.is_large_binary(out.type):
            out = self.text(rows, out)
        return out.cast(kind, safe=False)


def decode_together(payloads: pa.Array, writer, reader) -> tuple[pa.Array, np.ndarray]:
    """The payloads (no nulls) of one writer as structs of the reader's schema, and which are sound."""
    batch = _Batch(payloads)
    try:
        out = batch.read(np.arange(len(payloads)), parse(writer), parse(reader))
        return out, batch.ok & (batch.at == batch.end)
    except _NotVectorised:
        values, ok = [], []
        for data in payloads.to_pylist():
            try:
                values.append(resolve(decode(data, writer), writer, reader))
            except (ValueError, KeyError, TypeError, IndexError, UnicodeDecodeError):
                values.append(None)
            ok.append(values[-1] is not None)
        return pa.array(values, arrow_type(reader)), np.array(ok, bool)


def decoded(rows: DataFrame, reader, writers: dict[int, object]) -> DataFrame:
    """rows (schema_id, payload, ...) with the column `decoded`, a struct of the
    reader's schema; each payload is read under its own writer's schema. Null where
    the payload is null, the id unknown or the payload doesn't decode."""
    ship(rows.sparkSession)
    reader, writers = parse(reader), {k: parse(v) for k, v in writers.items()}
    kind, fields = spark_type(reader), arrow_type(reader)
    flagged = T.StructType([*kind.fields, T.StructField("_ok", T.BooleanType())])

    @F.arrow_udf(flagged)
    def read(ids: pa.Array, payloads: pa.Array) -> pa.Array:
        names = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        there = payloads.is_valid().to_numpy(zero_copy_only=False)
        parts, order, ok = [], [], np.zeros(len(ids), bool)
        for name, writer in writers.items():
            at = np.flatnonzero((names == name) & there)
            if len(at):
                values, sound = decode_together(payloads.take(pa.array(at)), writer, reader)
                parts.append(values.cast(fields))
                order.append(at)
                ok[at] = sound
        place = np.full(len(ids), -1)
        if order:
            place[np.concatenate(order)] = np.arange(sum(map(len, order)))
        all_values = pa.concat_arrays(parts) if parts else pa.array([], fields)
        structs = all_values.take(pa.array(place, mask=place < 0)) if len(all_values) else pa.nulls(len(ids), fields)
        columns = structs.flatten() if len(fields) else []
        return pa.StructArray.from_arrays([*columns, pa.array(ok)], fields=[*(pa.field(f.name, f.type) for f in fields), pa.field("_ok", pa.bool_())])

    chosen = F.struct(*(F.col(f"_read.`{n}`").alias(n) for n in kind.names))
    return rows.withColumn("_read", read(F.col("schema_id").cast("long"), "payload")).withColumn("decoded", F.when(F.col("_read._ok"), chosen)).drop("_read")


def encode_long(value: Column) -> Column:
    """SQL for Avro's variable-length zig-zag number of a non-negative long."""
    zig = F.shiftleft(value.cast("long"), 1)
    last = F.greatest(F.ceil(F.length(F.bin(zig)) / 7).cast("int"), F.lit(1)) - 1
    byte = lambda i: F.call_function("shiftrightunsigned", zig, (i * 7).cast("int")).bitwiseAND(F.lit(127).cast("long")).bitwiseOR(F.when(i < last, F.lit(128)).otherwise(0).cast("long"))
    return F.unhex(F.aggregate(F.sequence(F.lit(0), last), F.lit(""), lambda text, i: F.concat(text, F.lpad(F.hex(byte(i)), 2, "0"))))


def encode_string(value: Column) -> Column:
    """SQL for an Avro string."""
    return F.concat(encode_long(F.octet_length(value)), value.cast("binary"))
