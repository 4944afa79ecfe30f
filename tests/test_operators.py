import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.hashing import hmac_sha256, row_hash
from lodestrata.operators import conform, expectations as dq, history, masking, monitoring
from lodestrata.operators.lineage import Lineage
from lodestrata import jobs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_latest_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", None, 9), ("a", 1, 7), ("b", None, 1), (None, 3, 2)], "k string, o int, v int")
    assert rows(conform.latest(df, ["k"], ["o", "v"])) == rows(conform.latest_by_window(df, ["k"], ["o", "v"])) == sorted([("a", 1, 7), ("b", None, 1), (None, 3, 2)], key=str)


def test_row_hash_tells_null_from_empty(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "v string").withColumn("_meta", F.rand())
    assert df.select(row_hash(df).alias("h")).distinct().count() == 3


def test_hmac(spark):
    for key in (b"k", b"long" * 40):
        got = spark.createDataFrame([("é",), (None,)], "v string").select(hmac_sha256(F.col("v"), key)).collect()
        assert got[0][0] == hmac.new(key, "é".encode(), hashlib.sha256).hexdigest() and got[1][0] is None


def test_type_two_golden(spark):
    h = None
    for day, (addr, n) in enumerate([("9 Oak", 1), ("9 Oak", 1), ("18 Main", 2)]):
        h = history.record_history(h, spark.createDataFrame([("c", addr)], "id string, addr string"), ["id"], F.lit(f"2024-01-0{day + 1}").cast("timestamp"))
        assert h.count() == n
    assert history.offending_keys(h, ["id"]).count() == 0
    assert [r.addr for r in h.where("_is_current").collect()] == ["18 Main"]
    assert [str(r._valid_to) for r in h.where("not _is_current").collect()] == ["2024-01-03 00:00:00"]


def test_type_one_keeps_newer(spark):
    base = spark.createDataFrame([("a", 5, "x"), (None, 1, "n")], "id string, o int, v string")
    new = spark.createDataFrame([("a", 4, "late"), ("b", 1, "y"), (None, 2, "m")], "id string, o int, v string")
    assert rows(history.upsert(base, new, ["id"], "o")) == sorted([("a", 5, "x"), ("b", 1, "y"), (None, 2, "m")], key=str)
    assert history.history_skeleton(base).columns[-4:] == list(history.VALIDITY)


def test_expectations(spark):
    df = spark.createDataFrame([("1", "PAY-1", "5"), ("1", "pay-2", "abc"), (None, "zPAY", None), ("2", None, "9")], "id string, code string, amount string")
    suite = [
        {"expectation_type": "expect_column_values_to_be_unique", "kwargs": {"column": "id"}},
        {"expectation_type": "expect_column_values_to_match_regex", "kwargs": {"column": "code", "regex": "a|PAY"}},
        {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "amount", "min_value": 5, "max_value": 9}},
        {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "absent"}},
        {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "id", "value_set": []}},
        {"expectation_type": "expect_nothing", "kwargs": {}},
    ]
    out, n = dq.evaluate(df, suite)
    assert n == 4 and [(o.success, o.unexpected_count) for o in out] == [(False, 1), (False, 2), (False, 1), (False, 0), (False, 3), (False, 0)]
    assert "absent" in out[3].details["evaluation_error"]
    assert dq.evaluate(df.limit(0), suite[:3])[0][1].success
    marked = dq.violations(df, suite[:3])
    assert marked.count() == 3 and marked.where("id is null").first().violated_expectations == ["expect_column_values_to_match_regex:code"]
    assert dq.violations(df, []).count() == 0
    assert dq.score([]) == 0.0 and dq.severity(0.95, 0.95) == "P3" and dq.severity(0.91, 0.95) == "P2" and dq.severity(0.5, 0.95) == "P1"
    with pytest.raises(ValueError):
        dq.validate(df, {"expectations": suite}, "d", raise_on_failure=True)
    assert dq.validate(df, {"expectations": suite}, "d", threshold=0.0).passed


def test_gate_and_report(spark, tmp_path):
    df = spark.range(5)
    good = {"expectations": [{"expectation_type": "expect_column_to_exist", "kwargs": {"column": "id"}}], "name": "s"}
    bad = {"expectations": [{"expectation_type": "expect_column_to_exist", "kwargs": {"column": "x"}}]}
    assert dq.gate([], None)[0] == 0
    assert dq.gate([{"path": "a", "suite": good}], lambda _: df)[0] == 0
    assert dq.gate([{"path": "a", "suite": bad}], lambda _: df)[0] == 1
    assert dq.gate([{"path": "a", "suite": good}], lambda _: 1 / 0)[0] == 1
    paths = [x.removeprefix("file://") for x in dq.write_report(spark, dq.validate(df, good, "d"), f"file://{tmp_path}/reports")]
    assert json.load(open(paths[0]))["passed"] and "<table>" in open(paths[1]).read()
    (tmp_path / "one.json").write_text(json.dumps(good))
    assert dq.load_suite(str(tmp_path), "one")["name"] == "one" and list(dq.load_all(str(tmp_path))) == ["one"]
    with pytest.raises(FileNotFoundError, match="one"):
        dq.load_suite(str(tmp_path), "two")


def test_masking(spark):
    df = spark.createDataFrame([("ab@x.com", "1234567", "n"), (None, None, None), ("", "abc", "")], "email string, card string, note string")
    with pytest.raises(ValueError):
        masking.rules([{"column": "a", "strategy": "shred"}])
    with pytest.raises(ValueError):
        masking.masked(df, [masking.Rule("email", "tokenize")], env={})
    out, warnings = masking.masked(df, masking.rules([{"column": "email", "strategy": "tokenize"}, {"column": "card", "strategy": "mask_partial_last4"}, {"column": "note", "strategy": "drop"}, {"column": "gone", "strategy": "mask_full"}]), b"k")
    got = [tuple(r) for r in out.collect()]
    assert masking.token_of("ab@x.com", b"k") == got[0][0] and masking.token_of(None, b"k") is None
    assert got[0] == (hmac.new(b"k", b"ab@x.com", hashlib.sha256).hexdigest()[:32], "XXX4567") and got[1] == (None, None) and got[2][1] == "abc"
    assert warnings == ["no column gone"]


def test_erasure(spark, tmp_path):
    from lodestrata.plans.table import VersionedTable

    targets = []
    for name in ("raw", "conformed"):
        t = VersionedTable(spark, f"file://{tmp_path}/{name}")
        t.append(spark.createDataFrame([("s", "1"), ("s", "2"), ("o'\\", "3"), ("t", "4"), (None, "5")], "cid string, p string"))
        targets.append({"path": t.path, "key": "cid"})
    request = masking.ErasureRequest(["s", "o'\\"], [*targets, {"path": f"file://{tmp_path}/absent", "key": "cid"}])
    report = masking.erase(spark, request, f"file://{tmp_path}/audit")
    assert [r["rows_deleted"] for r in report.results] == [3, 3, 0] and not report.complete and report.rows_deleted == 6
    audit = VersionedTable(spark, f"file://{tmp_path}/audit").read().collect()
    assert len(audit) == 3 and [r.rows_deleted for r in audit if r.error is None] == [3, 3] and not any(r.complete for r in audit)
    assert masking.ErasureRequest.of({"subjects": ["a"], "targets": targets}).targets == targets
    for broken in ({"subjects": ["a"]}, {"subjects": [], "targets": targets}, {"subjects": ["a"], "targets": [{"path": "x"}]}, {"subjects": ["a"], "targets": [], "other": 1}):
        with pytest.raises(ValueError):
            masking.ErasureRequest.of(broken)
    with pytest.raises(ValueError):
        masking.erase(spark, masking.ErasureRequest([], targets))


def test_scores(spark):
    df = spark.createDataFrame([(5.0, 5.0, 0.0, 3), (6.0, 5.0, 0.0, 3), (4.0, 5.0, None, 1), (1.0, None, None, 0), (7.0, 5.0, 2.0, 9)], "v double, m double, s double, n int")
    assert [r[0] for r in df.select(monitoring.z_score(F.col("v"), F.col("m"), F.col("s"), F.col("n"))).collect()] == [0.0, float("inf"), float("-inf"), None, 1.0]


def test_run_log_and_jobs(spark, tmp_path):
    log = monitoring.RunLog(spark, f"file://{tmp_path}/runs")
    with pytest.raises(KeyError):
        log.end("none")
    done = []
    with pytest.raises(jobs.JobFailed) as failure:
        jobs.run_job("hourly", jobs.hourly(lambda: done.append(1), lambda: {"rows_written": 7}, lambda: 1), log)
    assert failure.value.args[0] == [("freshness", "succeeded"), ("merge", "succeeded"), ("quality_gate", "failed")]
    assert done == [1]
    states = monitoring.run_states(log.table.read()).collect()
    assert sorted((r.pipeline_name, r.status, r.rows_written) for r in states) == [("hourly.freshness", "succeeded", 0), ("hourly.merge", "succeeded", 7), ("hourly.quality_gate", "failed", 0)]
    assert jobs.submit_command("job.py", ["a:b:1"], {"k": "v"}, ["x"]) == ["spark-submit", "--packages", "a:b:1", "--conf", "k=v", "job.py", "x"]


def test_lineage_never_fails_the_job(spark):
    kept = []
    line = Lineage(spark, "n", lambda df: kept.append(df.first()))
    line.emit("START", "job", inputs=["a"], outputs=["b"])
    assert kept[0].job.name == "job" and kept[0].inputs[0].name == "a"
    broken = Lineage(spark, "n", lambda df: 1 / 0)
    broken.emit("FAIL", "job", error="x")
    assert broken.lost == 1


def test_alerts_and_exposition():
    from lodestrata.operators import sinks

    incident = {"severity": "P1", "title": "run_failed", "pipeline_name": "p", "run_id": None, "dedup_key": "pipeline-p-run_failed", "sinks": ["store", "chat", "pager"]}
    sent = sinks.deliver([incident], {"chat": lambda i: 200, "pager": lambda i: 1 / 0})
    assert sent[0]["codes"] == {"store": None, "chat": 200, "pager": -1}
    assert json.loads(sinks.pager_payload(incident, "k"))["payload"]["severity"] == "critical" and "[page]" in sinks.chat_payload(incident)
    assert sinks.exposition({"rows": 3}, {"topic": "t"}) == '# TYPE lodestrata_rows counter\nlodestrata_rows{topic="t"} 3\n'


def test_seasonalities_and_verdict(spark):
    # ten days at 9 h near 1000 and at 10 h near 10; the last day is scored
    past = [("p", f"2024-01-{d:02} {h:02}:00:00", v + d) for d in range(1, 11) for h, v in ((9, 1000.0), (10, 10.0))]
    late = [("p", "2024-01-20 09:00:00", 1005.0), ("p", "2024-01-20 10:00:00", 1005.0), ("q", "2024-01-20 09:00:00", 1.0)]
    series = spark.createDataFrame(past + late, "pipeline_name string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    def verdicts(*args):
        rows = monitoring.seasonal_scores(series, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), *args).orderBy("pipeline_name", "ts").collect()
        return [(r.basis, r.is_anomalous) for r in rows]

    assert verdicts() == [("all", False), ("all", False), (None, False)]
    assert verdicts("hour_of_day") == [("seasonal", False), ("seasonal", True), (None, False)]
    assert verdicts("hour_of_day", 1e6) == [("seasonal", False), ("seasonal", False), (None, False)]
    assert verdicts("none") == [("seasonal", False), ("seasonal", False), (None, False)]


def test_distinct_counts_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a", b"x", [1]), (1, None, b"y", [1]), (2, "a", None, [2]), (None, "", b"x", None)], "i int, s string, b binary, l array<int>")
    assert dq.distinct_counts(df, ["i", "s", "b", "l"]) == {"i": 2, "s": 2, "b": 2, "l": 2}
    assert dq.distinct_counts(df.limit(0), ["i"]) == {"i": 0} and dq.distinct_counts(df, []) == {}
    assert 0 < dq.sampled(spark.range(2000), 0.1).count() < 400


def test_monitor(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    now = [datetime(2024, 1, 1, tzinfo=timezone.utc)]
    slas = spark.createDataFrame([("p", 60, 100, 5)], "pipeline_name string, freshness_sla_minutes int, max_duration_minutes int, min_rows long")
    told = []
    m = monitoring.Monitor(spark, f"file://{tmp_path}/m", slas, {"chat": lambda i: told.append(i["title"]) or 200}, lambda: now[0])

    def run(rows, minutes, status="succeeded"):
        key = m.log.start("p")
        now[0] += timedelta(minutes=minutes)
        out = m.end(key, status, rows_written=rows)
        now[0] += timedelta(hours=8)
        return sorted(x["title"] for x in out)

    assert [run(100 + i, 10 + i % 2) for i in range(8)] == [[]] * 8
    assert run(3, 11) == ["min_rows", "volume_drop"] and run(104, 400) == ["duration_anomaly", "max_duration"] and run(0, 1, "failed") == ["run_failed"]
    assert sorted(told) == ["duration_anomaly", "max_duration", "min_rows", "run_failed", "volume_drop"]
    assert m.tables["anomalies"].read().count() == m.tables["incidents"].read().count() == 5
    assert len({x["partition"]["day"] for x in m.tables["incidents"].files()}) >= 2
    m.log.start("p")
    now[0] += timedelta(hours=5)
    assert m.reconcile() == 1 and m.reconcile() == 0 and m.tables["incidents"].read().where("title = 'stale_run' and severity = 'P2'").count() == 1
    report = dq.run_suite(spark.range(3), {"expectations": [{"expectation_type": "expect_column_to_exist", "kwargs": {"column": "x"}}]}, "d", monitor=m)
    assert not report.passed and m.tables["scores"].read().first().failed_expectations == 1
    with pytest.raises(ValueError):
        dq.run_suite(spark.range(3), {"expectations": []}, "d", raise_on_failure=True)


def test_steps_end_in_time(spark, tmp_path):
    import sys
    import time

    log = monitoring.RunLog(spark, f"file://{tmp_path}/runs")
    slow = F.udf(lambda x: time.sleep(30) or x, "long")
    began = time.time()
    with pytest.raises(jobs.JobFailed) as failure:
        jobs.run_job("j", [jobs.Step("slow", lambda: spark.range(1).select(slow("id")).collect(), 0.03), jobs.Step("next", lambda: 0)], log)
    assert time.time() - began < 25 and failure.value.args[0] == [("slow", "failed"), ("next", "skipped")]
    assert jobs.submit([sys.executable, "-c", "import os; raise SystemExit(int(os.environ['CODE']))"], {"CODE": "3"}) == 3
    assert jobs.submit([sys.executable, "-c", "import time; time.sleep(60)"], minutes=0.01) == 124


def test_wired_jobs_and_entry_points(spark, tmp_path, capsys):
    from lodestrata import cli
    from lodestrata.plans.table import VersionedTable
    from lodestrata.sources.specs import EntitySpec, MaintenanceSpec, maintenance_specs

    root = f"file://{tmp_path}"
    raw = VersionedTable(spark, f"{root}/raw", ("_date",))
    raw.append(spark.createDataFrame([("a", 1, 1, "2024-01-01"), ("a", 2, 2, "2024-01-02"), ("b", 1, 3, "2024-01-01")], "k string, v int, o long, _date string"))
    specs = [EntitySpec("one", raw.path, f"{root}/one", ("k",), "o"), EntitySpec("two", raw.path, f"{root}/two", ("k",), "o", history=2)]
    monitor = monitoring.Monitor(spark, f"{root}/m")
    good = {"expectations": [{"expectation_type": "expect_column_to_exist", "kwargs": {"column": "k"}}], "name": "s"}
    gated = [{"path": f"{root}/one", "suite": good}]
    assert jobs.run_job("hourly", jobs.wired_hourly(spark, specs, root, monitor, gated), monitor.log) == [("freshness", "succeeded"), ("merge", "succeeded"), ("quality_gate", "succeeded")]
    assert sorted((r.k, r.v) for r in VersionedTable(spark, f"{root}/one").read().collect()) == [("a", 2), ("b", 1)]
    assert VersionedTable(spark, f"{root}/two").read().where("_is_current").count() == 2
    raw.append(spark.createDataFrame([("a", 5, 9, "2024-01-03")], "k string, v int, o long, _date string"))
    jobs.merge_entities(spark, specs, root)
    assert sorted((r.k, r.v) for r in VersionedTable(spark, f"{root}/one").read().collect()) == [("a", 5), ("b", 1)] and VersionedTable(spark, f"{root}/two").read().count() == 3
    assert jobs.rebuild_entity(spark, specs[0], "2024-01-03") == {"rows_written": 1}
    nightly = jobs.wired_nightly(spark, monitor, [MaintenanceSpec(f"{root}/one"), MaintenanceSpec(raw.path, where="_date = '2024-01-01'")])
    assert [s for _, s in jobs.run_job("nightly", nightly, monitor.log)] == ["succeeded"] * 2
    with pytest.raises(jobs.JobFailed):
        jobs.run_job("nightly", jobs.wired_nightly(spark, monitor, [MaintenanceSpec(f"{root}/absent", where="x = 1", z_order=("q",))] ) + [jobs.Step("bad", lambda: 1)], monitor.log)

    def run(command, content, *more):
        (tmp_path / "in.json").write_text(json.dumps(content))
        return cli.main([command, str(tmp_path / "in.json"), *more], spark)

    assert run("gate", gated) == 0 and run("gate", [{"path": f"{root}/absent", "suite": good}]) == 1 and run("gate", [{"path": "x"}]) == 2
    assert run("erase", {"subjects": ["a"], "targets": [{"path": f"{root}/one", "key": "k"}]}, "--audit", f"{root}/audit") == 0
    assert run("erase", {"subjects": ["a"], "targets": [{"path": f"{root}/absent", "key": "k"}]}) == 1 and run("erase", {"subjects": []}) == 2
    assert run("maintain", [{"path": f"{root}/one", "vacuum_hours": 168}]) == 0 and run("maintain", [{"path": f"{root}/one", "nights": 1}]) == 2
    assert VersionedTable(spark, f"{root}/one").read().count() == 1 and VersionedTable(spark, f"{root}/audit").read().first().rows_deleted == 1
    assert maintenance_specs(env={"LODESTRATA_MAINTENANCE": '[{"path": "p", "z_order": ["a"]}]'}) == [MaintenanceSpec("p", ("a",))]


def test_streams_are_counted_and_stopped(spark, tmp_path):
    from lodestrata.streaming.conformed import Progress, lag_of
    from lodestrata.streaming.runner import Reporter, Runner

    progress, told = Progress(), []
    spark.streams.addListener(progress)
    try:
        queries = {n: spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.foreachBatch(lambda df, i: df.count()).option("checkpointLocation", f"file://{tmp_path}/{n}").start() for n in "ab"}
        runner = Runner(queries)
        with Reporter(progress, told.append, 0.2):
            import threading

            threading.Timer(6, runner.stop).start()
            assert runner.wait() == {"a": "stopped", "b": "stopped"}
        assert progress.started == 2 and progress.batches > 0 and any("lodestrata_batches" in x for x in told)

        def fail(df, i):
            raise RuntimeError("broken batch")

        queries = {"ok": spark.readStream.format("rate").load().writeStream.foreachBatch(lambda df, i: None).start(), "bad": spark.readStream.format("rate").load().writeStream.foreachBatch(fail).start()}
        with pytest.raises(Exception, match="broken batch"):
            Runner(queries).wait()
        assert not any(q.isActive for q in queries.values())
    finally:
        spark.streams.removeListener(progress)
    assert lag_of('{"t": {"0": 5, "1": 7}}', '{"t": {"0": 9, "1": 7}, "u": {"0": 2}}') == {"t/0": 4, "t/1": 0, "u/0": 2} and lag_of(None, "3") == {}
