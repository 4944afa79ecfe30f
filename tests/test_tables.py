import pytest

from lodestrata.plans.table import Conflict, VersionedTable, optimize_statement


@pytest.fixture
def t(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_append_is_idempotent_by_transaction(spark, t):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert not t.exists() and t.version() == -1
    assert t.append(df, ("app", 0)) == 0
    assert t.append(df, ("app", 0)) is None
    assert t.append(df, ("other", 0)) == 1
    assert t.append(df.limit(0), ("app", 5)) is None
    assert t.read().count() == 4
    assert t.read(0).count() == 2


def test_conflicting_commits(spark, t):
    df = spark.createDataFrame([(1,)], "id int")
    t.append(df)
    with pytest.raises(Conflict):
        t._commit(-1, "APPEND", [], [], "{}", {}, None)


def test_reading_while_overwriting(spark, t):
    t.append(spark.createDataFrame([(1,)], "id int"))
    before = t.read()
    t.overwrite(before.selectExpr("id + 1 as id"))
    assert rows(before) == [(1,)] and rows(t.read()) == [(2,)]


def test_delete_history_restore(spark, t):
    t.append(spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int"))
    assert t.delete_keys(spark.createDataFrame([("a",), ("x",), (None,)], "k string"), "k") == 1
    assert t.delete_keys(spark.createDataFrame([("a",)], "k string"), "k") == 0
    assert [r.operation for r in t.history().orderBy("version").collect()] == ["CREATE", "DELETE"]
    assert t.history().orderBy("version").collect()[1].operationMetrics["numDeletedRows"] == "1"
    t.restore(0)
    assert t.read().count() == 3


def test_changes_skip_rewrites(spark, t):
    t.append(spark.createDataFrame([(1,)], "id int"))
    t.append(spark.createDataFrame([(2,)], "id int"))
    t.optimize()
    assert rows(t.changes(0)) == [(2,)]


def test_optimize_and_vacuum(spark, t):
    for i in range(4):
        t.append(spark.range(i * 10, i * 10 + 10).selectExpr("id", "cast(id % 3 as string) s"))
    before = rows(t.read())
    assert t.optimize(["id", "s"])["numFilesRemoved"] >= 4
    assert rows(t.read()) == before
    with pytest.raises(ValueError):
        t.vacuum(hours=1)
    assert t.vacuum() == []
    later = t.commits()[-1].timestamp_ms + 1000 * 3_600_000
    gone = t.vacuum(now_ms=later)
    assert gone and t.vacuum(now_ms=later, dry_run=False) == gone and t.vacuum(now_ms=later) == []
    assert rows(t.read()) == before


def test_missing_table(t):
    with pytest.raises(FileNotFoundError):
        t.read()


def numbers(spark, *ids):
    return spark.createDataFrame([(i, "x") for i in ids], "id int, v string")


def test_rows_of_another_writer_are_kept(spark, tmp_path):
    """Another writer appends while an operation is under way."""
    from lodestrata.operators.history import upsert

    def begin(name):
        mine, other = (VersionedTable(spark, f"file://{tmp_path}/{name}") for _ in range(2))
        mine.append(numbers(spark, 1, 2).coalesce(1))
        mine.append(numbers(spark, 3))
        write, left = mine._write, [99]

        def interrupted(df, *args, **kwargs):
            out = write(df, *args, **kwargs)
            if left:
                other.append(numbers(spark, left.pop()))
            return out

        mine._write = interrupted
        return mine

    ids = lambda t: sorted(r.id for r in t.read().collect())
    t = begin("merge")
    t.merge(lambda current, new: upsert(current, new, ["id"]), spark.createDataFrame([(1, "y"), (5, "y")], "id int, v string"), keys=["id"])
    assert ids(t) == [1, 2, 3, 5, 99] and t.read().where("v = 'y'").count() == 2
    t = begin("whole")
    t.merge(lambda current, new: upsert(current, new, ["id"]), numbers(spark, 7))
    assert ids(t) == [1, 2, 3, 7, 99]
    t = begin("delete")
    assert t.delete_keys(numbers(spark, 1).select("id"), "id") == 1 and ids(t) == [2, 3, 99]
    t = begin("append")
    t.append(numbers(spark, 4), ("app", 1))
    assert t.append(numbers(spark, 4), ("app", 1)) is None and ids(t) == [1, 2, 3, 4, 99]
    t = begin("optimize")
    assert t.optimize()["numFilesRemoved"] >= 2 and ids(t) == [1, 2, 3, 99]
    t = begin("overwrite")
    with pytest.raises(Conflict):
        t.overwrite(t.read().where("id > 1"))
    assert ids(t) == [1, 2, 3, 99]
    t, other = begin("restore"), VersionedTable(spark, f"file://{tmp_path}/restore")
    commit = t._commit
    t._commit = lambda *args: (other.append(numbers(spark, 99)), commit(*args))[1]
    with pytest.raises(Conflict):
        t.restore(0)
    assert ids(t) == [1, 2, 3, 99]


def test_optimize_computes_anew_when_its_files_went(spark, tmp_path):
    mine, other = (VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    for i in range(3):
        mine.append(numbers(spark, i))
    write, left = mine._write, [1]

    def interrupted(df, *args, **kwargs):
        out = write(df, *args, **kwargs)
        if left:
            other.delete_keys(numbers(spark, left.pop()).select("id"), "id")
        return out

    mine._write = interrupted
    mine.optimize()
    assert sorted(r.id for r in mine.read().collect()) == [0, 2]


def test_merge_and_delete_leave_other_files(spark, t):
    from lodestrata.operators.history import upsert

    for i in range(5):
        t.append(numbers(spark, *range(10 * i, 10 * i + 10)).coalesce(1))
    before = {x["name"] for x in t.files()}
    t.merge(lambda current, new: upsert(current, new, ["id"]), spark.createDataFrame([(12, "new"), (None, "null")], "id int, v string").coalesce(1), keys=["id"])
    metrics = t.commits()[-1].metrics
    assert metrics["numFilesRemoved"] == 1 and metrics["numFilesKept"] == 4 and len(before & {x["name"] for x in t.files()}) == 4
    assert t.read().count() == 51 and t.read().where("v = 'new'").first().id == 12
    assert t.delete_keys(numbers(spark, 40, 41, 77).select("id"), "id") == 2 and t.commits()[-1].metrics["numFilesKept"] >= 4
    assert t.delete_keys(numbers(spark, *range(30, 40)).select("id"), "id") == 10 and t.commits()[-1].metrics["numFilesAdded"] == 0


def test_partitions_and_ranges(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", partition_by=("day", "k"), stats=("id", "k"))
    df = spark.range(60).selectExpr("id", "date_add(date'2024-01-01', cast(id % 3 as int)) as day", "if(id % 2 = 0, null, concat('a/', cast(id % 3 as string))) as k")
    for _ in range(2):
        t.append(df)
    assert rows(t.read()) == rows(df.unionAll(df))
    assert {x["partition"]["day"] for x in t.files()} == {"2024-01-01", "2024-01-02", "2024-01-03"} and {x["partition"]["k"] for x in t.files()} == {None, "a/0", "a/1", "a/2"}
    kept = {x["name"] for x in t.files() if x["partition"]["day"] != "2024-01-02"}
    done = t.optimize(where="day = '2024-01-02' and k is null")
    assert done["numFilesRemoved"] >= 2 and done["numFilesAdded"] == 1 and kept < {x["name"] for x in t.files()}
    assert rows(t.read()) == rows(df.unionAll(df))
    assert t.optimize(where="day > '2025-01-01'") == {"numFilesAdded": 0, "numFilesRemoved": 0}
    assert rows(t.read(between={"k": ("a/1", None)})) == rows(df.unionAll(df).where("k >= 'a/1'")) and len(t.holding({"k": ("a/1", "a/1")})) < len(t.files())
    assert t.holding({"id": (100, None)}) == [] and t.holding({"other": (1, 2)}) == [x["name"] for x in t.files()]


def test_checkpoints(spark, t, monkeypatch):
    from lodestrata.plans import table

    monkeypatch.setattr(table, "CHECKPOINT", 2)
    for i in range(5):
        t.append(numbers(spark, i), ("app", i))
    read, entries = VersionedTable(spark, t.path), []
    entry = read._entry
    read._entry = lambda n: (entries.append(n), entry(n))[1]
    s = read.snapshot()
    assert s.version == 4 and entries == [] and s.txns == {"app": 4} and len(s.files) == len(t.files())
    assert [read.read(v).count() for v in range(5)] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        read.read(9)


def test_statement():
    assert optimize_statement("x", "d > 1", ["a", "b"]) == "OPTIMIZE `x` WHERE d > 1 ZORDER BY (a, b)"
