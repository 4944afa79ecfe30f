"""A versioned Parquet table: immutable data files and a log of commits.

`_log/<version>.json` names the files a commit adds and removes, its operation,
metrics, schema, time and transaction; every tenth version has a checkpoint beside
it, so a snapshot is read from the last checkpoint and what followed. A commit
creates its log entry exclusively. An operation works on one snapshot from its
first read to its commit at the version after it: of two writers that began at the
same version one meets a `Conflict`. Appends are then committed again as they are,
merges and deletions are computed anew on the new version, and compaction holds if
its files are still live; overwriting and restoring raise. Data files are never
changed; readers of old versions keep reading them until a vacuum.

Merges and deletions by key rewrite the files that hold one of the keys and keep
the others. Partition values and, for the columns named in `stats`, least and
greatest values are kept with each file, so reads and compaction can leave files out.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lodestrata.functions.layout import z_value
from lodestrata.plans.files import Files

RETENTION_HOURS = 168
#: Versions from one checkpoint of the log to the next.
CHECKPOINT = 10
#: How often an operation is tried while others commit before it.
TRIES = 5
#: Prefix of the folders of partition values; the columns are in the files, too.
_PART = "_p_"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Commit:
    version: int
    operation: str
    timestamp_ms: int
    added: list[dict]
    removed: list[str]
    metrics: dict[str, int]
    txn: tuple[str, int] | None
    schema: str


@dataclass(frozen=True)
class Snapshot:
    """A version's files by name, schema, and the newest transaction of each application."""

    version: int = -1
    files: dict[str, dict] = field(default_factory=dict)
    schema: str = ""
    txns: dict[str, int] = field(default_factory=dict)

    def after(self, c: Commit) -> "Snapshot":
        files = {k: v for k, v in self.files.items() if k not in set(c.removed)} | {x["name"]: x for x in c.added}
        txns = self.txns | ({c.txn[0]: max(c.txn[1], self.txns.get(c.txn[0], c.txn[1]))} if c.txn else {})
        return Snapshot(c.version, files, c.schema, txns)

    def seen(self, txn: tuple[str, int] | None) -> bool:
        return txn is not None and self.txns.get(txn[0], txn[1] - 1) >= txn[1]

    @property
    def type(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


class VersionedTable:
    """partition_by: columns whose values files are divided by; stats: columns whose
    least and greatest values are kept for each file (numbers, strings, dates)."""

    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = (), stats: tuple[str, ...] = ()):
        self.spark, self.path, self.disk = spark, path.rstrip("/"), Files(spark)
        self.partition_by, self.stats = tuple(partition_by), tuple(stats)
        self._latest = Snapshot()

    # the log

    def _versions(self, ending: str) -> list[int]:
        return [int(x.removesuffix(ending)) for x in self.disk.names(f"{self.path}/_log") if x.endswith(ending) and not x.startswith(".")]

    def exists(self) -> bool:
        """Whether there is a commit. Errors of the file system aren't taken for absence."""
        return bool(self._versions(".json"))

    def _entry(self, version: int) -> Commit:
        raw = json.loads(self.disk.read(f"{self.path}/_log/{version:020d}.json"))
        raw["txn"] = tuple(raw["txn"]) if raw["txn"] else None
        return Commit(**raw)

    def commits(self, version: int | None = None, after: int = -1) -> list[Commit]:
        return [self._entry(n) for n in self._versions(".json") if n > after and (version is None or n <= version)]

    def version(self) -> int:
        """The newest version; -1 if there is no table."""
        return max(self._versions(".json"), default=-1)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The table as of a version (the newest, if none is named)."""
        there = self._versions(".json")
        if version is not None and version not in there:
            raise ValueError(f"no version {version} of {self.path}")
        target = max(there, default=-1) if version is None else version
        base = self._latest if self._latest.version <= target else Snapshot()
        kept = max((n for n in self._versions(".checkpoint") if n <= target), default=-1)
        if kept > base.version:
            base = Snapshot(**json.loads(self.disk.read(f"{self.path}/_log/{kept:020d}.checkpoint")))
        for n in there:
            if base.version < n <= target:
                base = base.after(self._entry(n))
        if version is None:
            self._latest = base
        return base

    def _commit(self, base: int, operation: str, added: list[dict], removed: list[str], schema: str, metrics: dict, txn: tuple[str, int] | None) -> int:
        n = base + 1
        entry = {"version": n, "operation": operation, "timestamp_ms": int(time.time() * 1000), "added": added, "removed": removed, "metrics": metrics, "txn": txn, "schema": schema}
        log = f"{self.path}/_log"
        if not self.disk.write_new(f"{log}/{n:020d}.json", json.dumps(entry), f"{log}/.{uuid.uuid4().hex}"):
            raise Conflict(f"version {n} of {self.path} exists")
        if n and n % CHECKPOINT == 0:
            s = self.snapshot(n)
            self.disk.write(f"{log}/{n:020d}.checkpoint", json.dumps({"version": s.version, "files": s.files, "schema": s.schema, "txns": s.txns}))
        return n

    # reading

    def files(self, version: int | None = None) -> list[dict]:
        return list(self.snapshot(version).files.values())

    def schema(self, version: int | None = None) -> StructType:
        return self.snapshot(version).type

    def read(self, version: int | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
        """The table as of a version (the newest, if none is named). between: column ->
        (least, greatest), either may be None; files that can't hold such rows aren't read."""
        s = self.snapshot(version)
        if s.version < 0:
            raise FileNotFoundError(f"no table at {self.path}")
        rows = self._scan(self.holding(between or {}, s), s.type)
        for name, (low, high) in (between or {}).items():
            for bound, keep in ((low, lambda c, b: c >= b), (high, lambda c, b: c <= b)):
                if bound is not None:
                    rows = rows.where(keep(F.col(f"`{name}`"), F.lit(bound)))
        return rows

    def holding(self, between: dict[str, tuple], snapshot: Snapshot | None = None) -> list[str]:
        """Names of the files that may hold rows in all of the ranges."""

        def may(entry: dict) -> bool:
            for name, (low, high) in between.items():
                least, most = entry.get("range", {}).get(name, (None, None))
                if least is None or most is None:
                    if name in entry.get("range", {}):
                        return False  # nothing but nulls
                    continue
                plain = lambda x: x if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
                if (low is not None and most < plain(low)) or (high is not None and least > plain(high)):
                    return False
            return True

        return [k for k, x in (snapshot or self.snapshot()).files.items() if may(x)]

    def _scan(self, names: list[str], schema: StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{x}" for x in names))

    def history(self) -> DataFrame:
        """version, operation, timestamp, operationMetrics, numAdded, numRemoved, txnApp, txnVersion; a row a commit."""
        rows = [(c.version, c.operation, c.timestamp_ms, {k: str(v) for k, v in c.metrics.items()}, len(c.added), len(c.removed), *(c.txn or (None, None))) for c in self.commits()]
        ddl = "version long, operation string, ms long, operationMetrics map<string,string>, numAdded int, numRemoved int, txnApp string, txnVersion long"
        return self.spark.createDataFrame(rows, ddl).select("version", "operation", F.timestamp_millis("ms").alias("timestamp"), "operationMetrics", "numAdded", "numRemoved", "txnApp", "txnVersion")

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """Rows appended after a version; commits that only rewrite rows are skipped."""
        commits = [c for c in self.commits(upto, after) if c.operation in ("APPEND", "CREATE")]
        return self._scan([x["name"] for c in commits for x in c.added], self.schema(upto))

    # writing

    def _write(self, df: DataFrame, sort: Column | None = None, files: int | None = None) -> list[dict]:
        folder, schema = uuid.uuid4().hex, df.schema
        parts = [F.col(f"`{c}`") for c in self.partition_by]
        if sort is not None:
            df = df.repartitionByRange(files or 1, *parts, sort).sortWithinPartitions(*parts, sort)
        elif files:
            df = df.repartition(files, *parts) if parts else df.repartition(files)
        writer = df.withColumns({_PART + c: F.col(f"`{c}`") for c in self.partition_by}).write
        (writer.partitionBy(*(_PART + c for c in self.partition_by)) if parts else writer).parquet(f"{self.path}/data/{folder}")
        out = {}
        for name, size, _ in self.disk.below(f"{self.path}/data/{folder}"):
            if name.endswith(".parquet"):
                values = dict(x[len(_PART) :].split("=", 1) for x in name.split("/")[:-1])
                values = {k: None if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v) for k, v in values.items()}
                out[f"{folder}/{name}"] = {"name": f"{folder}/{name}", "bytes": size} | ({"partition": values} if values else {})
        if self.stats and out:
            kinds = dict(zip(schema.names, (f.dataType.typeName() for f in schema)))
            numbers = ("integer", "long", "short", "byte", "double", "float")
            kept = [c for c in self.stats if c in kinds]
            values = [(F.col(f"`{c}`") if kinds[c] in numbers else F.col(f"`{c}`").cast("string")).alias(f"s{i}") for i, c in enumerate(kept)]
            ends = [f(f"s{i}").alias(f"{k}{i}") for i in range(len(kept)) for k, f in (("l", F.min), ("h", F.max))]
            for row in self._located(self._scan(list(out), schema), *values).groupBy("_file").agg(*ends, F.count("*").alias("n")).collect():
                out[self._name(row["_file"])] |= {"range": {c: [row[f"l{i}"], row[f"h{i}"]] for i, c in enumerate(kept)}, "rows": row["n"]}
        return list(out.values())

    @staticmethod
    def _located(rows: DataFrame, *columns) -> DataFrame:
        return rows.select(*columns, F.col("_metadata.file_path").alias("_file"))

    @staticmethod
    def _name(file_path: str) -> str:
        return unquote(file_path).rsplit("/data/", 1)[1]

    def _transact(self, work: Callable[[Snapshot], tuple | None], txn: tuple[str, int] | None = None, on_conflict: str = "again") -> int | None:
        """Commit what `work` makes of a snapshot: (operation, added, removed, schema,
        metrics), or None for nothing. on_conflict: `again` computes anew, `keep` commits
        the same if the removed files are still live (else anew), `raise` gives up."""
        done, base = None, None
        for attempt in range(TRIES):
            s = self.snapshot()
            if s.seen(txn):
                break
            if done is None or on_conflict != "keep" or not set(done[2]) <= set(s.files):
                self._drop(done)
                base, done = s, work(s)
                if done is None:
                    return None
            operation, added, removed, schema, metrics = done
            try:
                return self._commit(s.version, operation if s.version >= 0 else "CREATE", added, removed, schema, metrics, txn)
            except Conflict:
                if on_conflict == "raise" or attempt == TRIES - 1:
                    self._drop(done)
                    raise
        self._drop(done)
        return None

    def _drop(self, done: tuple | None) -> None:
        """Remove the files of a commit that was not made."""
        if done and done[0] != "RESTORE":
            for folder in {x["name"].split("/")[0] for x in done[1]}:
                self.disk.delete(f"{self.path}/data/{folder}")

    def append(self, df: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        """Add rows. None, and nothing written, if the transaction was seen before or there are no rows."""

        def work(s: Snapshot):
            added = [] if df.isEmpty() else self._write(df)
            return ("APPEND", added, [], json.dumps(df.schema.jsonValue()), {"numFiles": len(added)}) if added else None

        return self._transact(work, txn, "keep")

    def overwrite(self, df: DataFrame, txn: tuple[str, int] | None = None, operation: str = "OVERWRITE", metrics: dict | None = None) -> int | None:
        """Replace all rows, in one commit; also creates the table. Conflict if another
        commit was made meanwhile: what `df` was computed from may have changed."""

        def work(s: Snapshot):
            added = self._write(df)
            return operation, added, list(s.files), json.dumps(df.schema.jsonValue()), (metrics or {}) | {"numFiles": len(added)}

        return self._transact(work, txn, "raise")

    def merge(self, fold, updates: DataFrame, txn: tuple[str, int] | None = None, keys: list[str] | None = None, among: Column | None = None) -> int | None:
        """Commit fold(current rows or None, updates) as the new rows. With `keys` the
        fold gets, and the commit replaces, only the files that hold a row with the keys
        of an update (of the rows that `among` selects, if given); so it must keep rows
        of other keys as they are."""

        def work(s: Snapshot):
            if s.version < 0:
                new, removed = fold(None, updates), []
            else:
                removed = list(s.files) if keys is None else list(self._with_keys(s, updates, keys, among))
                new = fold(self._scan(removed, s.type), updates)
            added = self._write(new)
            return "MERGE", added, removed, json.dumps(new.schema.jsonValue()), {"numFilesAdded": len(added), "numFilesRemoved": len(removed), "numFilesKept": len(s.files) - len(removed)}

        return self._transact(work, txn)

    def _with_keys(self, s: Snapshot, rows: DataFrame, keys: list[str], among: Column | None = None) -> dict[str, int]:
        """The files with a row whose keys are those of one of `rows`, and how many. Reads the keys only."""
        if not s.files:
            return {}
        current = self._scan(list(s.files), s.type)
        current = self._located(current if among is None else current.where(among), *(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)))
        named = rows.select(*(F.col(f"`{k}`").alias(f"n{i}") for i, k in enumerate(keys))).distinct()
        same = reduce(lambda a, b: a & b, [F.col(f"k{i}").eqNullSafe(F.col(f"n{i}")) for i in range(len(keys))])
        return {self._name(r["_file"]): r["n"] for r in current.join(named, same, "left_semi").groupBy("_file").agg(F.count("*").alias("n")).collect()}

    def delete_keys(self, keys: DataFrame, on: str) -> int:
        """Delete rows whose `on` is among the keys' (first column); how many there were.
        Files without such rows stay as they are."""
        named = keys.select(F.col(keys.columns[0]).alias(on)).where(F.col(on).isNotNull()).distinct()
        counted = [0]

        def work(s: Snapshot):
            if s.version < 0:
                raise FileNotFoundError(f"no table at {self.path}")
            hit = self._with_keys(s, named, [on])
            counted[0] = sum(hit.values())
            if not hit:
                return None
            rows = self._scan(list(hit), s.type)
            left = rows.join(named.select(F.col(on).alias("_gone")), rows[on].eqNullSafe(F.col("_gone")), "left_anti")
            added = [] if left.isEmpty() else self._write(left)
            return "DELETE", added, list(hit), s.schema, {"numDeletedRows": counted[0], "numFilesAdded": len(added), "numFilesRemoved": len(hit), "numFilesKept": len(s.files) - len(hit)}

        self._transact(work)
        return counted[0]

    def restore(self, version: int) -> int:
        """Make an old version the newest one. Conflict if another commit was made meanwhile."""
        old = self.snapshot(version)

        def work(s: Snapshot):
            return "RESTORE", [x for k, x in old.files.items() if k not in s.files], sorted(set(s.files) - set(old.files)), old.schema, {"restored": version}

        return self._transact(work, None, "raise")

    # maintenance

    def optimize(self, z_order: list[str] | None = None, target_bytes: int = 1 << 30, where: str = "") -> dict[str, int]:
        """Rewrite files as files of about target_bytes; rows don't change. Without
        z_order only files under three quarters of that are joined, those of a partition
        among themselves; with it all are clustered anew. where: a condition on
        partition columns that chooses files."""
        found = {"numFilesAdded": 0, "numFilesRemoved": 0}

        def work(s: Snapshot):
            chosen = [s.files[k] for k in (self._where(s, where) if where else s.files)]
            if not z_order:
                small: dict[str, list[dict]] = {}
                for x in chosen:
                    if 4 * x["bytes"] < 3 * target_bytes:
                        small.setdefault(json.dumps(x.get("partition"), sort_keys=True), []).append(x)
                chosen = [x for group in small.values() if len(group) > 1 for x in group]
            if not chosen:
                return None
            df = self._scan([x["name"] for x in chosen], s.type)
            n = max(1, -(-sum(x["bytes"] for x in chosen) // target_bytes))
            added = self._write(df, z_value(df, z_order) if z_order else None, n)
            found.update(numFilesAdded=len(added), numFilesRemoved=len(chosen))
            return "OPTIMIZE", added, [x["name"] for x in chosen], s.schema, dict(found)

        if self._transact(work, None, "keep") is None:
            found.update(numFilesAdded=0, numFilesRemoved=0)
        return found

    def _where(self, s: Snapshot, condition: str) -> list[str]:
        """Names of the files whose partition values meet a condition."""
        names = sorted({k for x in s.files.values() for k in x.get("partition", {})})
        kinds = {f.name: f.dataType for f in s.type}
        rows = [(name, *(x.get("partition", {}).get(k) for k in names)) for name, x in s.files.items()]
        if not rows:
            return []
        listed = self.spark.createDataFrame(rows, ", ".join(["_name string", *(f"`{k}` string" for k in names)]))
        return [r["_name"] for r in listed.select("_name", *(F.col(f"`{k}`").cast(kinds[k]).alias(k) for k in names)).where(condition).collect()]

    def vacuum(self, hours: float = RETENTION_HOURS, dry_run: bool = True, force: bool = False, now_ms: int | None = None) -> list[str]:
        """Data files that no version younger than `hours` needs; deleted unless
        dry_run. Less than the usual retention has to be forced."""
        if hours < RETENTION_HOURS and not force:
            raise ValueError(f"retention under {RETENTION_HOURS} h has to be forced")
        now = int(time.time() * 1000) if now_ms is None else now_ms
        limit = now - hours * 3_600_000
        live, needed = Snapshot(), set()
        for c in self.commits():
            before, live = live, live.after(c)
            if c.timestamp_ms >= limit:
                needed |= set(before.files) | set(live.files)
        needed |= set(live.files)
        gone = sorted(name for name, _, changed in self.disk.below(f"{self.path}/data") if name.endswith(".parquet") and name not in needed and changed < limit)
        if not dry_run:
            for name in gone:
                self.disk.delete(f"{self.path}/data/{name}")
        return gone


def optimize_statement(path: str, where: str = "", z_order: list[str] | None = None) -> str:
    """The same maintenance as a statement, for engines that take one."""
    return f"OPTIMIZE `{path}`" + (f" WHERE {where}" if where else "") + (f" ZORDER BY ({', '.join(z_order)})" if z_order else "")
