"""Registered queries over the test tables, and SQL that gives the same rows.

Instants are given as microseconds since the epoch, so no session's zone matters.
Defects (nulls, broken frames) are put into whole tables by rule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestrata.functions.hashing import row_hash
from lodestrata.operators import conform, expectations as dq, history, lineage, masking, monitoring, sinks
from lodestrata.plans.table import VersionedTable
from lodestrata.session import instant, shared_folder, table
from lodestrata.sources import avro, wire

KEY = b"token_key of the registered queries"
AS_OF = "2024-01-31 00:00:00"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", instant("ts"))


def dirty_events(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.withColumns({"user_id": F.when(F.col("event_id") % 97 == 0, None).otherwise(F.col("user_id")), "value": F.when(F.col("event_id") % 89 == 0, None).otherwise(F.col("value"))})


DIRTY = "(select event_id, ts, case when event_id % 97 = 0 then null else user_id end as user_id, event_type, case when event_id % 89 = 0 then null else value end as value, props from events)"

# conformed rows


@query("dedup_latest", "select event_id, user_id, event_type, epoch_us(ts) as ts_us, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def dedup_latest(spark, sf):
    return conform.latest(events(spark, sf), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("ts_us"), "value")


@query("dedup_latest_window", SQL["dedup_latest"])
def dedup_latest_window(spark, sf):
    return conform.latest_by_window(events(spark, sf), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("ts_us"), "value")


REASON = "case when user_id is null then 'null_primary_key' when value is null then 'missing_required' end"


@query("quarantine_routing", f"select event_id, {REASON} as quarantine_reason from {DIRTY}")
def quarantine_routing(spark, sf):
    return conform.with_reason(dirty_events(spark, sf), ["user_id"], ["value"]).select("event_id", "quarantine_reason")


@query("quarantine_profile", f"select {REASON} as quarantine_reason, count(*) as n from {DIRTY} where user_id is null or value is null group by 1")
def quarantine_profile(spark, sf):
    return conform.reason_profile(conform.validated(dirty_events(spark, sf), ["user_id"], ["value"])[1])


@query("union_by_name", f"select event_id, user_id, {REASON} as quarantine_reason from {DIRTY}")
def union_by_name(spark, sf):
    clean, bad = conform.validated(dirty_events(spark, sf), ["user_id"], ["value"])
    return clean.select("event_id", "user_id").unionByName(bad.select("quarantine_reason", "user_id", "event_id"), allowMissingColumns=True)


@query("exact_duplicates", "select doc_id, first_key, copies from (select doc_id, min(doc_id) over (partition by text) as first_key, count(*) over (partition by text) as copies from documents where text is not null) where doc_id > first_key")
def exact_duplicates(spark, sf):
    return conform.exact_duplicates(table(spark, sf, "documents"), "doc_id", "text")


# messages


def writers() -> dict[int, dict]:
    new = {"type": "record", "name": "Event", "fields": [{"name": "event_id", "type": "long"}, {"name": "event_type", "type": "string"}, {"name": "props", "type": ["null", "string"], "default": None}]}
    return {7: new, 8: {"type": "record", "name": "Event", "fields": new["fields"][:2]}}


_MESSAGES: dict[tuple[str, str], str] = {}


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """The events as framed messages, written once for a session and a data folder."""
    name = spark.sparkContext.applicationId, sf
    if name not in _MESSAGES:
        path = f"{shared_folder(spark)}/messages/{uuid.uuid4().hex}"
        made_messages(spark, sf).write.parquet(path)
        _MESSAGES[name] = path
    return spark.read.schema(wire.RECORD).parquet(_MESSAGES[name])


def made_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The events as framed messages: views under an older schema (id 8), some broken."""
    e = events(spark, sf)
    older = F.col("event_type") == "view"
    head = F.concat(avro.encode_long(F.col("event_id")), avro.encode_string(F.col("event_type")))
    tail = F.concat(F.unhex(F.lit("02")), avro.encode_string(F.col("props")))
    framed = wire.frame(F.when(older, head).otherwise(F.concat(head, tail)), F.when(F.col("event_id") % 59 == 0, 999).when(older, 8).otherwise(7))
    broken = F.when(F.col("event_id") % 53 == 0, F.unhex(F.concat(F.lit("FF"), F.substring(F.hex(framed), 3, 1 << 20)))).when(F.col("event_id") % 61 == 0, None).when(F.col("event_id") % 67 == 0, F.unhex(F.lit("0000"))).otherwise(framed)
    return e.select(broken.alias("value"), F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"))


ROUTE = "case when event_id % 53 = 0 then 'invalid_wire_format' when event_id % 61 = 0 then 'null_value' when event_id % 67 = 0 then 'invalid_wire_format' when event_id % 59 = 0 then 'unknown_schema_id' end"


@query("wire_header_decode", f"select event_id as _kafka_offset, epoch_us(ts) // 1000 as _kafka_timestamp_ms, case when event_id % 53 = 0 or event_id % 61 = 0 or event_id % 67 = 0 then null when event_id % 59 = 0 then 999 when event_type = 'view' then 8 else 7 end::bigint as schema_id, {ROUTE} as quarantine_reason from events")
def wire_header_decode(spark, sf):
    return wire.routed(messages(spark, sf), [7, 8], at(AS_OF)).select("_kafka_offset", "_kafka_timestamp_ms", "schema_id", "quarantine_reason")


@query("avro_decode", f"select event_id, event_type, case when event_type = 'view' then null else props end as props, epoch_us(ts) // 1000 as _kafka_timestamp_ms from events where ({ROUTE}) is null")
def avro_decode(spark, sf):
    from lodestrata.streaming.raw import decode_batch

    return decode_batch(messages(spark, sf), writers()[7], writers(), at(AS_OF))[0].select("event_id", "event_type", "props", "_kafka_timestamp_ms")


@query("dead_letters", f"select event_id as message_offset, {ROUTE} as error, event_type as topic from events where ({ROUTE}) is not null")
def dead_letters(spark, sf):
    bad = wire.split(wire.routed(messages(spark, sf), [7, 8], at(AS_OF)))[1]
    rows = wire.dead_letters(bad, "raw")
    return rows.select(F.col("headers")["offset"].cast("long").alias("message_offset"), F.col("headers")["error"].alias("error"), F.col("headers")["topic"].alias("topic"))


@query("offset_high_watermark", 'select event_type as topic, user_id % 4 as "partition", max(event_id) + 1 as next_offset from events group by 1, 2')
def offset_high_watermark(spark, sf):
    return conform.high_watermarks(messages(spark, sf).select("topic", "partition", "offset"))


@query("consumer_lag", "with p as (select event_type as topic, user_id % 4 as \"partition\", max(event_id) + 1 as e, max(event_id) filter (ts < timestamp '2024-01-15') + 1 as c from events group by 1, 2) select topic, \"partition\", e - coalesce(c, 0) as lag from p")
def consumer_lag(spark, sf):
    m = messages(spark, sf)
    ends = conform.high_watermarks(m).withColumnRenamed("next_offset", "end_offset")
    return conform.lag(ends, conform.high_watermarks(m.where(F.col("timestamp") < at("2024-01-15"))))


# changing dimensions


def order_batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders until 1999 as they were, and those since 1998 with their status changed."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    return o.where(F.col("o_orderdate") < at("1999-01-01")), o.where(F.col("o_orderdate") >= at("1998-01-01")).withColumn("o_orderstatus", F.concat(F.lit("changed "), "o_orderstatus"))


@query("scd1_upsert", "select o_orderkey, case when o_orderdate >= timestamp '1998-01-01' then 'changed ' || o_orderstatus else o_orderstatus end as o_orderstatus, epoch_us(o_orderdate) as date_us from orders")
def scd1_upsert(spark, sf):
    base, updates = order_batches(spark, sf)
    return history.upsert(base, updates, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", F.unix_micros("o_orderdate").alias("date_us"))


@query("scd1_ordered", "select event_id, user_id, event_type, epoch_us(ts) as ts_us from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def scd1_ordered(spark, sf):
    """The later half first: older updates must not win."""
    e = events(spark, sf).select("event_id", "user_id", "event_type", "ts")
    late, early = (conform.latest(e.where(c), ["user_id"], ["ts", "event_id"]) for c in (F.col("ts") >= at("2024-01-15"), F.col("ts") < at("2024-01-15")))
    return history.upsert(late, early, ["user_id"], "ts").select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("ts_us"))


CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00", AS_OF)
_BATCHES = " union all ".join(
    f"select user_id, event_type, timestamp '{b}' as ts from (select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where ts < timestamp '{b}'" + (f" and ts >= timestamp '{a}'" if a else "") + ") where rn = 1"
    for a, b in zip((None, *CUTS[:2]), CUTS)
)
_STATES = f"(select user_id, event_type, epoch_us(ts) as from_us, epoch_us(lead(ts) over (partition by user_id order by ts)) as to_us from (select *, lag(event_type) over (partition by user_id order by ts) as last from ({_BATCHES})) where last is null or last <> event_type)"


def event_batches(spark: SparkSession, sf: str) -> list[tuple[DataFrame, Column]]:
    e, out = events(spark, sf), []
    for a, b in zip((None, *CUTS[:2]), CUTS):
        part = e.where(F.col("ts") < at(b)) if a is None else e.where((F.col("ts") < at(b)) & (F.col("ts") >= at(a)))
        out.append((conform.latest(part, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type"), at(b)))
    return out


def event_history(spark: SparkSession, sf: str) -> DataFrame:
    current = None
    for batch, when in event_batches(spark, sf):
        current = history.record_history(current, batch, ["user_id"], when)
    return current


def _validity(df: DataFrame) -> DataFrame:
    return df.select("user_id", "event_type", F.unix_micros("_valid_from").alias("from_us"), F.unix_micros("_valid_to").alias("to_us"))


@query("scd2_history", f"select user_id, event_type, from_us, to_us from {_STATES}")
def scd2_history(spark, sf):
    return _validity(event_history(spark, sf))


@query("scd2_from_changes", SQL["scd2_history"])
def scd2_from_changes(spark, sf):
    changes = [b.withColumn("changed_at", when) for b, when in event_batches(spark, sf)]
    return _validity(history.history_of(changes[0].unionByName(changes[1]).unionByName(changes[2]), ["user_id"], "changed_at"))


@query("scd2_current", f"select user_id, event_type, from_us from {_STATES} where to_us is null")
def scd2_current(spark, sf):
    return _validity(event_history(spark, sf).where("_is_current")).drop("to_us")


@query("scd2_invariants", f"with k as (select user_id, count(*) filter (to_us is null) as c from {_STATES} group by 1) select count(*) as keys, count(*) filter (c <> 1) as offending from k")
def scd2_invariants(spark, sf):
    h = event_history(spark, sf)
    offending = history.offending_keys(h, ["user_id"]).agg(F.count("*").alias("offending"))
    return h.agg(F.count_distinct("user_id").alias("keys")).join(offending)  # one row each


@query("row_hash_equality", f"select user_id, value, count(*) as rows_alike from {DIRTY} group by 1, 2")
def row_hash_equality(spark, sf):
    rows = dirty_events(spark, sf).select("user_id", "value", F.col("event_id").alias("_id"))
    return rows.groupBy(row_hash(rows).alias("h")).agg(F.first("user_id").alias("user_id"), F.first("value").alias("value"), F.count("*").alias("rows_alike")).drop("h")


# quality


def quality_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dirty_events(spark, sf).withColumn("code", F.concat(F.when(F.col("event_id") % 83 == 0, "ev-").otherwise("EV-"), "event_type"))


QROWS = f"(select *, (case when event_id % 83 = 0 then 'ev-' else 'EV-' end) || event_type as code from {DIRTY})"
SUITE = [
    {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "user_id", "mostly": 0.98}},
    {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "user_id"}},
    {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "event_type", "value_set": ["view", "signup", "click", "purchase"], "mostly": 0.7}},
    {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "value", "min_value": 1, "max_value": 200}},
    {"expectation_type": "expect_column_values_to_match_regex", "kwargs": {"column": "code", "regex": "EV-|XX", "mostly": 0.9}},
    {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1}},
    {"expectation_type": "expect_table_columns_to_match_ordered_list", "kwargs": {"column_list": ["event_id", "ts"]}},
    {"expectation_type": "expect_column_to_exist", "kwargs": {"column": "props"}},
    {"expectation_type": "expect_column_values_to_be_of_type", "kwargs": {"column": "event_id", "type_": "BIGINT"}},
    {"expectation_type": "expect_column_mean_to_be_between", "kwargs": {"column": "value", "min_value": 0, "max_value": 1000}},
    {"expectation_type": "expect_column_sum_to_be_between", "kwargs": {"column": "value", "max_value": 0}},
    {"expectation_type": "expect_moon_phase", "kwargs": {}},
]
_N = f"(select count(*) from {QROWS})"


def _row_sql(column: str, bad: str, mostly: float, all_rows: bool = False) -> str:
    base = "count(*)" if all_rows else f"count({column})"
    return f"select {base} as element_count, count(*) filter ({bad}) as unexpected_count, round(100.0 * count(*) filter ({bad}) / {base}, 6)::double as unexpected_percent, ({base} - count(*) filter ({bad})) / {base}::double >= {mostly} as success from {QROWS}"


_DQ = {
    "not_be_null": (0, _row_sql("user_id", "user_id is null", 0.98, True)),
    "be_unique": (1, f"select count(*) as element_count, count(user_id) - count(distinct user_id) as unexpected_count, round(100.0 * (count(user_id) - count(distinct user_id)) / count(*), 6)::double as unexpected_percent, count(user_id) = count(distinct user_id) as success from {QROWS}"),
    "be_in_set": (2, _row_sql("event_type", "event_type not in ('view', 'signup', 'click', 'purchase')", 0.7)),
    "be_between": (3, _row_sql("value", "value < 1 or value > 200", 1.0)),
    "match_regex": (4, _row_sql("code", "not regexp_matches(code, '^(?:EV-|XX)')", 0.9)),
    "row_count": (5, f"select {_N} as element_count, 0::bigint as unexpected_count, 0.0::double as unexpected_percent, true as success"),
    "ordered_columns": (6, "select 0::bigint as element_count, 0::bigint as unexpected_count, 0.0::double as unexpected_percent, false as success"),
    "column_exists": (7, "select 0::bigint as element_count, 0::bigint as unexpected_count, 0.0::double as unexpected_percent, true as success"),
    "column_type": (8, "select 0::bigint as element_count, 0::bigint as unexpected_count, 0.0::double as unexpected_percent, true as success"),
    "column_mean": (9, f"select {_N} as element_count, 0::bigint as unexpected_count, 0.0::double as unexpected_percent, avg(value) between 0 and 1000 as success from {QROWS}"),
    "column_sum": (10, f"select {_N} as element_count, 0::bigint as unexpected_count, 0.0::double as unexpected_percent, sum(value) <= 0 as success from {QROWS}"),
    "unsupported": (11, "select 0::bigint as element_count, 0::bigint as unexpected_count, 0.0::double as unexpected_percent, false as success"),
}


def _dq(position: int):
    def run(spark, sf):
        rows = quality_rows(spark, sf)
        report = dq.validate(rows, {"expectations": [SUITE[position]]}, "events")
        return dq.results_frame(spark, report).select("element_count", "unexpected_count", F.round("unexpected_percent", 6).alias("unexpected_percent"), "success")

    return run


for _name, (_position, _sql) in _DQ.items():
    query(f"dq_{_name}", _sql)(_dq(_position))


@query("dq_suite_score", f"with o as ({' union all '.join(f'select success from ({s})' for _, s in _DQ.values())}), s as (select round(avg(case when success then 1.0 else 0.0 end), 6)::double as score from o) select score, case when score >= 0.95 then 'P3' when score >= 0.9 then 'P2' else 'P1' end as severity, {_N} as row_count from s")
def dq_suite_score(spark, sf):
    r = dq.validate(quality_rows(spark, sf), {"expectations": SUITE}, "events")
    return spark.createDataFrame([(round(r.score, 6), r.severity, r.row_count)], "score double, severity string, row_count long")


@query("dq_violations", f"""select event_id, array_to_string(list_filter([case when user_id is null then 'expect_column_values_to_not_be_null:user_id' end, case when event_type = 'error' then 'expect_column_values_to_be_in_set:event_type' end,
 case when value < 1 or value > 200 then 'expect_column_values_to_be_between:value' end, case when code like 'ev%' then 'expect_column_values_to_match_regex:code' end], lambda x: x is not null), ',') as violated from {QROWS}
 where user_id is null or event_type = 'error' or value < 1 or value > 200 or code like 'ev%'""")
def dq_violations(spark, sf):
    suite = [SUITE[i] for i in (0, 2, 3, 4)]
    return dq.violations(quality_rows(spark, sf), suite).select("event_id", F.array_join("violated_expectations", ",").alias("violated"))


# privacy

_PAD = KEY.ljust(64, b"\0")
_INNER, _OUTER = (bytes(b ^ pad for b in _PAD).hex() for pad in (0x36, 0x5C))


def _token_sql(c: str) -> str:
    return f"substr(sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode({c})))), 1, 32)"


@query("pii_tokenize", f"select c_custkey, {_token_sql('c_name')} as c_name from customer")
def pii_tokenize(spark, sf):
    return masking.masked(table(spark, sf, "customer").select("c_custkey", "c_name"), [masking.Rule("c_name", "tokenize")], KEY)[0]


@query("pii_mask_full", "select doc_id, repeat('X', length(text)) as text from documents")
def pii_mask_full(spark, sf):
    return masking.masked(table(spark, sf, "documents").select("doc_id", "text"), [masking.Rule("text", "mask_full")])[0]


@query("pii_last4", "select c_custkey, repeat('X', greatest(length(c_name) - 4, 0)::bigint) || right(c_name, 4) as c_name from customer")
def pii_last4(spark, sf):
    return masking.masked(table(spark, sf, "customer").select("c_custkey", "c_name"), [masking.Rule("c_name", "mask_partial_last4")])[0]


@query("pii_drop", "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer")
def pii_drop(spark, sf):
    return masking.masked(table(spark, sf, "customer"), [masking.Rule("c_name", "drop"), masking.Rule("absent", "drop")])[0]


@query("tokenize_join", "select c_mktsegment, count(*) as orders from orders join customer on o_custkey = c_custkey group by 1")
def tokenize_join(spark, sf):
    """Joined by token instead of key."""
    o = table(spark, sf, "orders").select(masking.token(F.col("o_custkey"), KEY).alias("t"))
    c = table(spark, sf, "customer").select(masking.token(F.col("c_custkey"), KEY).alias("t"), "c_mktsegment")
    return o.join(c, "t").groupBy("c_mktsegment").agg(F.count("*").alias("orders"))


@query("delete_keys", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'MACHINERY')")
def delete_keys(spark, sf):
    gone = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return masking.without(table(spark, sf, "orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("erase_subjects", "select 'customer' as target, count(*) as rows_deleted from customer where c_mktsegment = 'MACHINERY' union all select 'orders', count(*) from orders join customer on o_custkey = c_custkey where c_mktsegment = 'MACHINERY'")
def erase_subjects(spark, sf):
    names = {}
    for name, key in (("customer", "c_custkey"), ("orders", "o_custkey")):
        t = _fresh(spark, name)
        t.append(table(spark, sf, name))
        names[t.path] = (name, key, t)
    gone = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    rows = [(name, t.delete_keys(gone, key)) for name, key, t in names.values()]
    return spark.createDataFrame(rows, "target string, rows_deleted long")


# runs


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Each event type and day is a run: a row at its start, one at its end. Days of
    error events end as failed; the last day's view and click runs don't end."""
    day = events(spark, sf).groupBy(F.col("event_type").alias("pipeline_name"), F.to_date("ts").alias("day")).agg(F.min("ts").alias("started_at_utc"), F.max("ts").alias("ended_at_utc"), F.count("*").alias("rows_written"))
    day = day.withColumn("run_id", F.concat_ws("/", "pipeline_name", F.col("day").cast("string")))
    ends = day.where(~((F.col("day") == F.lit("2024-01-30").cast("date")) & F.col("pipeline_name").isin("view", "click")))
    end = ends.select("run_id", "pipeline_name", "started_at_utc", "ended_at_utc", "rows_written", F.when(F.col("pipeline_name") == "error", "failed").otherwise("succeeded").alias("status"), ((F.unix_micros("ended_at_utc") - F.unix_micros("started_at_utc")) / 1e6).alias("duration_seconds"), F.col("ended_at_utc").alias("recorded_at"))
    start = day.select("run_id", "pipeline_name", "started_at_utc", F.lit(None).cast("timestamp").alias("ended_at_utc"), F.lit(0).cast("long").alias("rows_written"), F.lit("running").alias("status"), F.lit(None).cast("double").alias("duration_seconds"), (F.col("started_at_utc") - F.expr("interval 1 second")).alias("recorded_at"))
    return start.unionByName(end)


RUNS = """(select *, event_type || '/' || day::varchar as run_id, case when day = date '2024-01-30' and event_type in ('view', 'click') then 'running' when event_type = 'error' then 'failed' else 'succeeded' end as status
 from (select event_type, ts::date as day, min(ts) as s, max(ts) as e, count(*) as n from events group by 1, 2))"""
_US = f"epoch_us(timestamp '{AS_OF}')"
_LASTED = "case when status <> 'running' then (epoch_us(e) - epoch_us(s)) / 1e6 end"


@query("run_latest_state", f"select run_id, event_type as pipeline_name, status, case when status = 'running' then 0 else n end as rows_written from {RUNS}")
def run_latest_state(spark, sf):
    return monitoring.run_states(runs(spark, sf)).select("run_id", "pipeline_name", "status", "rows_written")


_ROLL = f"(select run_id, event_type, n, s, count(*) over w as c, avg(n) over w as m, stddev_samp(n) over w as d from {RUNS} where status = 'succeeded' window w as (partition by event_type order by s, run_id rows between 30 preceding and 1 preceding))"
_Z = "case when c = 0 then null when (case when c = 1 then 0 else d end) = 0 then (case when n = m then 0 when n > m then 'inf'::double else '-inf'::double end) else (n - m) / d end"


@query("run_rolling_zscore", f"select run_id, c as n, round({_Z}, 6) as z from {_ROLL}")
def run_rolling_zscore(spark, sf):
    done = monitoring.run_states(runs(spark, sf)).where("status = 'succeeded'")
    return monitoring.rolling_scores(done, "rows_written").select("run_id", "n", F.round("z", 6).alias("z"))


@query("volume_anomalies", f"select run_id, case when z < 0 then 'volume_drop' else 'volume_spike' end as anomaly_type, case when abs(z) > 5 then 'P1' else 'P2' end as severity, n::double as observed_value from (select *, {_Z} as z from {_ROLL}) where c >= 7 and abs(z) > 3")
def volume_anomalies(spark, sf):
    return monitoring.volume_anomalies(monitoring.run_states(runs(spark, sf))).select("run_id", "anomaly_type", "severity", "observed_value")


@query("run_incidents", f"select run_id, 'run_failed' as title, 'P1' as severity, 'pipeline-' || event_type || '-run_failed' as dedup_key, 'store,chat,pager' as sinks from {RUNS} where status = 'failed' union all select run_id, 'min_rows', 'P2', 'pipeline-' || event_type || '-min_rows', 'store,chat' from {RUNS} where status = 'succeeded' and n < 60")
def run_incidents(spark, sf):
    found = monitoring.run_checks(monitoring.run_states(runs(spark, sf)), slas(spark))
    return monitoring.incidents(found, at(AS_OF)).select("run_id", "title", "severity", "dedup_key", F.array_join("sinks", ",").alias("sinks"))


def slas(spark: SparkSession) -> DataFrame:
    rows = [(x, 60, 100_000, 60) for x in ("view", "signup", "error", "click", "purchase", "absent")]
    return spark.createDataFrame(rows, "pipeline_name string, freshness_sla_minutes int, max_duration_minutes int, min_rows long")


@query("freshness_breach", f"select p.pipeline_name, epoch_us(l.e) as last_us, case when l.e is null then 'never_succeeded' when ({_US} - epoch_us(l.e)) / 60e6 <= 60 then 'ok' when ({_US} - epoch_us(l.e)) / 60e6 - 60 > 30 then 'P1' else 'P2' end as verdict from (values ('view'), ('signup'), ('error'), ('click'), ('purchase'), ('absent')) p(pipeline_name) left join (select event_type, max(e) as e from {RUNS} where status = 'succeeded' group by 1) l on l.event_type = p.pipeline_name")
def freshness_breach(spark, sf):
    f = monitoring.freshness(monitoring.run_states(runs(spark, sf)), slas(spark), at(AS_OF))
    return f.select("pipeline_name", F.unix_micros("last_success").alias("last_us"), "verdict")


@query("stale_runs", f"select run_id, 'failed' as status, round(({_US} - epoch_us(s)) / 1e6, 3) as duration_seconds from {RUNS} where status = 'running'")
def stale_runs(spark, sf):
    stale = monitoring.stale_runs(runs(spark, sf), at(AS_OF))
    return monitoring.superseding(stale, at(AS_OF)).select("run_id", "status", F.round("duration_seconds", 3).alias("duration_seconds"))


@query("run_health", f"select event_type as pipeline_name, count(*) as runs, count(*) filter (status = 'succeeded') as succeeded, count(*) filter (status = 'failed') as failed, round(count(*) filter (status = 'succeeded') / count(*)::double, 4) as success_rate, round(avg({_LASTED}), 3) as avg_duration, round(max({_LASTED}), 3) as max_duration, round(min({_LASTED}), 3) as min_duration from {RUNS} where epoch_us(s) >= {_US} - 240 * 3600000000 group by 1")
def run_health(spark, sf):
    return monitoring.health(runs(spark, sf), at(AS_OF), 240).select("pipeline_name", "runs", "succeeded", "failed", "success_rate", *(F.round(c, 3).alias(c) for c in ("avg_duration", "max_duration", "min_duration")))


SPLIT = "2024-01-27 00:00:00"
_SERIES = "(select event_type as p, time_bucket(interval 15 minute, ts) as t, round(sum(value), 2) as v from events group by 1, 2)"


@query("seasonal_mad", f"""with s as (select *, isodow(t) - 1 as wd, hour(t) as h from {_SERIES}), past as (select * from s where t < timestamp '{SPLIT}'),
 a as (select p, wd, h, count(*) as n, median(v) as m from past group by 1, 2, 3), ad as (select p, wd, h, n, m, median(abs(v - m)) as d from past join a using (p, wd, h) group by 1, 2, 3, 4, 5),
 b as (select p, count(*) as n, median(v) as m from past group by 1), bd as (select p, n, m, median(abs(v - m)) as d from past join b using (p) group by 1, 2, 3),
 j as (select s.p, s.t, s.v, case when ad.n >= 8 then 'seasonal' when bd.n >= 4 then 'all' end as basis, case when ad.n >= 8 then ad.m when bd.n >= 4 then bd.m end as m, case when ad.n >= 8 then ad.d when bd.n >= 4 then bd.d end as d
  from s left join ad on ad.p = s.p and ad.wd = s.wd and ad.h = s.h left join bd on bd.p = s.p where s.t >= timestamp '{SPLIT}')
 select p as pipeline_name, epoch_us(t) as ts_us, basis, round(m, 4) as median, round(case when d = 0 then (case when v = m then 0 else 'inf'::double end) else 0.6745 * (v - m) / d end, 4) as score from j""")
def seasonal_mad(spark, sf):
    series = events(spark, sf).groupBy(F.col("event_type").alias("pipeline_name"), F.window("ts", "15 minutes")["start"].alias("ts")).agg(F.round(F.sum("value"), 2).alias("value"))
    s = monitoring.seasonal_scores(series, at(SPLIT))
    return s.select("pipeline_name", F.unix_micros("ts").alias("ts_us"), "basis", F.round("median", 4).alias("median"), F.round("score", 4).alias("score"))


_SECONDS = "(case when run_id = 'click/2024-01-25' then 4 else 1 end * (epoch_us(e) - epoch_us(s)) / 1e6)"
_SLOW = f"select run_id, case when z > 5 then 'P1' else 'P2' end as severity, round(z, 4) as z from (select *, case when c = 0 then null when (case when c = 1 then 0 else d end) = 0 then (case when x = m then 0 when x > m then 'inf'::double else '-inf'::double end) else (x - m) / d end as z from (select run_id, {_SECONDS} as x, count(*) over w as c, avg({_SECONDS}) over w as m, stddev_samp({_SECONDS}) over w as d from {RUNS} where status = 'succeeded' window w as (partition by event_type order by s, run_id rows between 30 preceding and 1 preceding))) where c >= 7 and z > 3"


@query("duration_anomalies", _SLOW)
def duration_anomalies(spark, sf):
    return monitoring.duration_anomalies(monitoring.run_states(slow_runs(spark, sf))).select("run_id", "severity", F.round("z_score", 4).alias("z"))


def slow_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs, those of clicks on the 25th four times as long."""
    slow = (F.col("run_id") == "click/2024-01-25") & F.col("duration_seconds").isNotNull()
    return runs(spark, sf).withColumn("duration_seconds", F.when(slow, 4 * F.col("duration_seconds")).otherwise(F.col("duration_seconds")))


def _monitor(spark: SparkSession) -> monitoring.Monitor:
    return monitoring.Monitor(spark, f"{shared_folder(spark)}/monitoring/{uuid.uuid4().hex}", slas(spark))


@query("stored_anomalies", f"select run_id, anomaly_type, severity, \"day\" from (select run_id, case when z < 0 then 'volume_drop' else 'volume_spike' end as anomaly_type, case when abs(z) > 5 then 'P1' else 'P2' end as severity, '2024-01-31' as \"day\" from (select *, {_Z} as z from {_ROLL}) where c >= 7 and abs(z) > 3) union all select run_id, 'duration_anomaly', severity, '2024-01-31' from ({_SLOW})")
def stored_anomalies(spark, sf):
    """Both kinds of anomalies of all runs, by way of the table that is divided by day."""
    m = _monitor(spark)
    m.add_anomalies(monitoring.run_anomalies(monitoring.run_states(slow_runs(spark, sf))), at(AS_OF))
    t = m.tables["anomalies"]
    kept = t.read(between={"day": (None, None)}) if t.exists() else spark.createDataFrame([], "run_id string, anomaly_type string, severity string, day date")
    return kept.select("run_id", "anomaly_type", "severity", F.col("day").cast("string").alias("day"))


@query("stored_incidents", f"select run_id, 'run_failed' as title, 'P1' as severity, 0::int as stored, 200::int as pager from {RUNS} where status = 'failed' and day >= date '2024-01-28'")
def stored_incidents(spark, sf):
    """Incidents of the last failed runs, sent to a pager and stored with its answers."""
    m = _monitor(spark)
    m.sinks["pager"] = lambda incident: 200
    failed = monitoring.run_states(runs(spark, sf)).where((F.col("status") == "failed") & (F.col("started_at_utc") >= at("2024-01-28")))
    m.add_incidents(monitoring.run_checks(failed, slas(spark)).where("anomaly_type = 'run_failed'"), at(AS_OF))
    return m.tables["incidents"].read().select("run_id", "title", "severity", F.col("codes")["store"].alias("stored"), F.col("codes")["pager"].alias("pager"))


@query("stored_scores", f"select 'events' as dataset_name, 12::bigint as total_expectations, passed as passed_expectations, {_N} as row_count, case when passed / 12.0 >= 0.95 then 'P3' when passed / 12.0 >= 0.9 then 'P2' else 'P1' end as severity, {_N} > 0 and passed / 12.0 < 0.95 as alerted from (select count(*) filter (success) as passed from ({' union all '.join(f'select success from ({x})' for _, x in _DQ.values())}))")
def stored_scores(spark, sf):
    """A validation as a whole: report, stored score, alert."""
    m = _monitor(spark)
    dq.run_suite(quality_rows(spark, sf), {"expectations": SUITE, "name": "events"}, "events", reports=f"{shared_folder(spark)}/reports/{uuid.uuid4().hex}", monitor=m)
    alerted = F.lit(m.tables["incidents"].exists() and not m.tables["incidents"].read().where("title = 'quality_below_threshold'").isEmpty())
    return m.tables["scores"].read().select("dataset_name", "total_expectations", "passed_expectations", "row_count", "severity", alerted.alias("alerted"))


@query("dq_score_history", "select event_type || '/' || ts::date::varchar as run_id, round(avg(case when value <= 300 then 1.0 else 0.0 end), 6)::double as score from events where event_type = 'view' and ts >= timestamp '2024-01-24' group by 1")
def dq_score_history(spark, sf):
    day = events(spark, sf).groupBy(F.col("event_type").alias("dataset_name"), F.to_date("ts").alias("day")).agg(F.round(F.avg(F.when(F.col("value") <= 300, 1.0).otherwise(0.0)), 6).alias("score"))
    scores = day.select("dataset_name", "score", F.concat_ws("/", "dataset_name", F.col("day").cast("string")).alias("run_id"), F.col("day").cast("timestamp").alias("evaluated_at_utc"))
    return dq.score_history(scores, "view", at(AS_OF), 7).select("run_id", "score")


@query("hourly_layout", 'select strftime(ts, \'%Y\') as "year", strftime(ts, \'%m\') as "month", strftime(ts, \'%d\') as "day", strftime(ts, \'%H\') as "hour", count(*) as n from events group by 1, 2, 3, 4')
def hourly_layout(spark, sf):
    path = f"{shared_folder(spark)}/hourly/{uuid.uuid4().hex}"
    sinks.write_hourly(events(spark, sf), F.col("ts"), path)
    kept = spark.read.option("basePath", path).schema("event_id long, year string, month string, day string, hour string").parquet(path)
    return kept.groupBy(*sinks.HOURLY).agg(F.count("*").alias("n"))


@query("bound_statement", "select event_type, count(*) as n, max(value) as top from events where value > 100 and event_type <> 'error' group by 1")
def bound_statement(spark, sf):
    events(spark, sf).createOrReplaceTempView("lodestrata_events")
    return sinks.query(spark, "select event_type, count(*) as n, max(value) as top from lodestrata_events where value > :least and event_type <> :kind group by 1", least=100, kind="error")


@query("recent_topk", "select event_id, epoch_us(ts) as ts_us from events where event_type = 'error' order by ts desc, event_id limit 10")
def recent_topk(spark, sf):
    errors = events(spark, sf).where("event_type = 'error'").select(F.col("event_id").alias("anomaly_id"), F.col("ts").alias("detected_at_utc"))
    return monitoring.newest(errors).select(F.col("anomaly_id").alias("event_id"), F.unix_micros("detected_at_utc").alias("ts_us"))


@query("lineage_events", f"select case status when 'failed' then 'FAIL' else 'COMPLETE' end as event_type, run_id, epoch_us(e) as time_us from {RUNS} where status <> 'running' union all select 'START', run_id, epoch_us(s) from {RUNS}")
def lineage_events(spark, sf):
    rows = runs(spark, sf).withColumns({"source_table": F.lit("events"), "target_table": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string")})
    return lineage.events_of(rows, "lodestrata").select(F.col("eventType").alias("event_type"), F.col("run.runId").alias("run_id"), F.unix_micros("eventTime").alias("time_us"))


# tables and streams


def _fresh(spark: SparkSession, name: str) -> VersionedTable:
    return VersionedTable(spark, f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}")


_ORDERS = "select o_orderkey, o_custkey, o_orderstatus from orders"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("txn_replay", _ORDERS)
def txn_replay(spark, sf):
    t = _fresh(spark, "replay")
    for _ in range(2):
        t.append(_orders(spark, sf), ("app", 1))
    return t.read()


@query("table_history", "select * from (values (0::bigint, 'CREATE', null::varchar), (1, 'APPEND', null), (2, 'DELETE', (select count(*)::varchar from orders where o_orderstatus = 'F')), (3, 'RESTORE', null)) h(version, operation, deleted)")
def table_history(spark, sf):
    t, o = _fresh(spark, "history"), _orders(spark, sf)
    t.append(o.where("o_orderstatus = 'F'"))
    t.append(o.where("o_orderstatus <> 'F'"))
    t.delete_keys(spark.createDataFrame([("F",)], "s string"), "o_orderstatus")
    t.restore(1)
    return t.history().select("version", "operation", F.try_element_at("operationMetrics", F.lit("numDeletedRows")).alias("deleted"))


@query("time_travel", "select 0 as version, count(*) filter (o_orderstatus = 'F') as n from orders union all select 1, count(*) from orders")
def time_travel(spark, sf):
    t, o = _fresh(spark, "travel"), _orders(spark, sf)
    t.append(o.where("o_orderstatus = 'F'"))
    t.append(o.where("o_orderstatus <> 'F'"))
    parts = [t.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("n")) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


@query("optimize_roundtrip", "select o_orderstatus, count(*) as n, sum(o_orderkey)::bigint as keys, true as joined from orders group by 1")
def optimize_roundtrip(spark, sf):
    """Three appends in many files each; compaction leaves fewer files and the same rows."""
    t, o = _fresh(spark, "optimize"), _orders(spark, sf).repartition(4)
    for status in ("F", "O", "P"):
        t.append(o.where(F.col("o_orderstatus") == status))
    before = len(t.files())
    done = t.optimize()
    joined = done["numFilesRemoved"] == before and len(t.files()) == done["numFilesAdded"] == 1
    return t.read().groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.lit(joined).alias("joined"))


@query("optimize_where", "select o_orderstatus, count(*) as n, o_orderstatus = 'F' as rewritten from orders group by 1")
def optimize_where(spark, sf):
    """Compaction of one partition leaves the files of the others as they are."""
    t, o = VersionedTable(spark, f"{shared_folder(spark)}/tables/where-{uuid.uuid4().hex}", ("o_orderstatus",)), _orders(spark, sf)
    for part in (o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")):
        t.append(part.coalesce(2))
    before = {x["name"] for x in t.files()}
    t.optimize(where="o_orderstatus = 'F'")
    rewritten = {x["partition"]["o_orderstatus"] for x in t.files() if x["name"] not in before}
    kept = {x["partition"]["o_orderstatus"] for x in t.files() if x["name"] in before}
    fresh = F.col("o_orderstatus").isin(sorted(rewritten - kept))
    return t.read().groupBy("o_orderstatus").agg(F.count("*").alias("n")).select("o_orderstatus", "n", fresh.alias("rewritten"))


@query("zorder_layout", "select count(*) filter (o_custkey between 20 and 40) as by_custkey, count(*) filter (o_totalprice between 1000 and 20000) as by_price, true as fewer_files, count(*) as n from orders")
def zorder_layout(spark, sf):
    """Ranges of either clustered column read a part of the files only."""
    t = VersionedTable(spark, f"{shared_folder(spark)}/tables/zorder-{uuid.uuid4().hex}", stats=("o_custkey", "o_totalprice"))
    t.append(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    size = sum(x["bytes"] for x in t.files())
    t.optimize(["o_custkey", "o_totalprice"], max(1, size // 16))
    ranges = {"o_custkey": (20, 40), "o_totalprice": (1000, 20000)}
    counts = [t.read(between={k: v}).count() for k, v in ranges.items()]
    fewer = all(len(t.holding({k: v})) <= 0.7 * len(t.files()) for k, v in ranges.items()) and len(t.files()) > 4
    return t.read().agg(F.lit(counts[0]).cast("long").alias("by_custkey"), F.lit(counts[1]).cast("long").alias("by_price"), F.lit(fewer).alias("fewer_files"), F.count("*").alias("n"))


@query("merge_touches_few_files", "select count(*) as n, count(*) filter (o_orderkey = (select min(o_orderkey) from orders)) as changed, 1::bigint as files_removed, true as others_kept from orders")
def merge_touches_few_files(spark, sf):
    """The merge of one key rewrites the file that holds it."""
    t, o = _fresh(spark, "few"), _orders(spark, sf)
    t.append(o.repartitionByRange(8, "o_orderkey"))
    files = len(t.files())
    first = o.agg(F.min("o_orderkey").alias("o_orderkey"), F.lit(0).cast("long").alias("o_custkey"), F.lit("changed").alias("o_orderstatus"))
    t.merge(lambda current, updates: history.upsert(current, updates, ["o_orderkey"]), first, ("few", 0), ["o_orderkey"])
    metrics = t.commits()[-1].metrics
    return t.read().agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "changed").alias("changed"), F.lit(metrics["numFilesRemoved"]).cast("long").alias("files_removed"), F.lit(metrics["numFilesKept"] == files - 1).alias("others_kept"))


@query("vacuum_dry_run", "select true as old_files_found, count(*) as rows_kept from orders")
def vacuum_dry_run(spark, sf):
    t = _fresh(spark, "vacuum")
    t.append(_orders(spark, sf))
    t.overwrite(_orders(spark, sf))
    later = t.commits()[-1].timestamp_ms + 400 * 3_600_000
    return t.read().agg(F.lit(bool(t.vacuum(now_ms=later))).alias("old_files_found"), F.count("*").alias("rows_kept"))


@query("scd1_table_merge", SQL["scd1_upsert"])
def scd1_table_merge(spark, sf):
    t = _fresh(spark, "merge")
    for k, batch in enumerate(order_batches(spark, sf)):
        t.merge(lambda current, updates: history.upsert(current, updates, ["o_orderkey"]), batch, ("merge", k), ["o_orderkey"])
    return t.read().select("o_orderkey", "o_orderstatus", F.unix_micros("o_orderdate").alias("date_us"))


@query("stream_available_now_conformed", SQL["dedup_latest"])
def stream_available_now_conformed(spark, sf):
    from lodestrata.sources.specs import EntitySpec
    from lodestrata.streaming.conformed import await_all, conformed_batch_writer, start_conformed

    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    events(spark, sf).repartitionByRange(3, "event_id").write.parquet(f"{base}/in")
    spec = EntitySpec("latest_event", "events", f"{base}/table", ("user_id",), "ts", ties=("event_id",))
    target = VersionedTable(spark, spec.target)
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    write = conformed_batch_writer(spec, target, VersionedTable(spark, f"{base}/quarantine"))
    await_all(spark, [start_conformed(stream, write, f"{base}/checkpoint", available_now=True)])
    return target.read().select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("ts_us"), "value")


@query("stream_available_now_raw", f"select coalesce({ROUTE}, 'valid') as route, count(*) as n from events group by 1")
def stream_available_now_raw(spark, sf):
    from lodestrata.sources.registry import SchemaRegistry
    from lodestrata.sources.specs import TopicSpec
    from lodestrata.streaming.conformed import await_all
    from lodestrata.streaming.raw import file_stream, raw_batch_writer, start_raw

    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    renumbered = {7: 2, 8: 1, 999: 999}
    number = F.create_map(*(F.lit(x) for pair in renumbered.items() for x in pair))
    m = messages(spark, sf)
    header = F.when(wire.framed(), F.unhex(F.concat(F.lit("00"), F.lpad(F.hex(number[wire.schema_id().cast("int")].cast("long")), 8, "0"), F.hex(wire.payload())))).otherwise(F.col("value"))
    m.withColumn("value", header).repartitionByRange(3, "offset").write.parquet(f"{base}/in")
    registry = SchemaRegistry(spark, f"{base}/schemas")
    registry.register("events-value", writers()[8])
    registry.register("events-value", writers()[7])
    data, bad = VersionedTable(spark, f"{base}/data"), VersionedTable(spark, f"{base}/quarantine")
    await_all(spark, [start_raw(file_stream(spark, f"{base}/in"), raw_batch_writer(TopicSpec("events", "events-value"), registry, data, bad), f"{base}/checkpoint", available_now=True)])
    routes = data.read().select(F.lit("valid").alias("route")).unionByName(bad.read().select(F.col("quarantine_reason").alias("route")))
    return routes.groupBy("route").agg(F.count("*").alias("n"))


@query("stream_table_to_conformed", SQL["dedup_latest"])
def stream_table_to_conformed(spark, sf):
    """Appends of a raw table streamed into the next layer, in two goes; compaction
    between them brings no rows again."""
    from lodestrata.sources.specs import EntitySpec
    from lodestrata.streaming.runner import Runner, start_entities

    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    raw, e = VersionedTable(spark, f"{base}/raw"), events(spark, sf)
    spec = EntitySpec("latest", raw.path, f"{base}/table", ("user_id",), "ts", ties=("event_id",))
    for k in range(2):
        raw.append(e.where(F.pmod("event_id", F.lit(4)) == 2 * k).coalesce(2))
        raw.append(e.where(F.pmod("event_id", F.lit(4)) == 2 * k + 1).coalesce(2))
        raw.optimize()
        Runner(start_entities(spark, [spec], base, available_now=True)).wait()
    return VersionedTable(spark, spec.target).read().select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("ts_us"), "value")
