"""Column masking and erasure of subjects."""

from __future__ import annotations

import hashlib
import hmac
import os
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.functions.hashing import hmac_sha256

STRATEGIES = ("tokenize", "mask_full", "mask_partial_last4", "drop")
TOKEN_CHARS = 32
KEY_SETTING = "LODESTRATA_TOKEN_KEY"


@dataclass(frozen=True)
class Rule:
    column: str
    strategy: str


def rules(raw: list[dict]) -> list[Rule]:
    out = []
    for x in raw:
        if missing := {"column", "strategy"} - set(x):
            raise ValueError(f"masking rule lacks {', '.join(sorted(missing))}")
        if x["strategy"] not in STRATEGIES:
            raise ValueError(f"unknown strategy {x['strategy']}: {', '.join(STRATEGIES)}")
        out.append(Rule(x["column"], x["strategy"]))
    return out


def token(value: Column, key: bytes) -> Column:
    """A keyed token: equal values give equal tokens, so joins on them still hold."""
    return F.substring(hmac_sha256(value.cast("string"), key), 1, TOKEN_CHARS)


def token_of(value: str | None, key: bytes) -> str | None:
    """The same token of one value, on the driver: to look a subject up, say."""
    return None if value is None else hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:TOKEN_CHARS]


def mask_full(value: Column) -> Column:
    return F.repeat(F.lit("X"), F.length(value.cast("string")))


def mask_last4(value: Column) -> Column:
    """All but the last four characters masked; values of up to four stay."""
    s = value.cast("string")
    return F.concat(F.repeat(F.lit("X"), F.greatest(F.length(s) - 4, F.lit(0))), F.right(s, F.lit(4)))


def masked(df: DataFrame, masking: list[Rule], key: bytes | None = None, env=os.environ) -> tuple[DataFrame, list[str]]:
    """(the masked rows, warnings). Columns that don't exist are skipped with a
    warning. Tokens need a key, given or in the environment."""
    if any(r.strategy == "tokenize" for r in masking) and key is None:
        if not env.get(KEY_SETTING):
            raise ValueError(f"tokens need a key or {KEY_SETTING}")
        key = env[KEY_SETTING].encode()
    new, gone, warnings = {}, [], []
    for r in masking:
        if r.column not in df.columns:
            warnings.append(f"no column {r.column}")
        elif r.strategy == "drop":
            gone.append(r.column)
        else:
            c = F.col(f"`{r.column}`")
            new[r.column] = token(c, key) if r.strategy == "tokenize" else mask_full(c) if r.strategy == "mask_full" else mask_last4(c)
    return df.withColumns(new).drop(*gone), warnings


@dataclass
class ErasureRequest:
    subjects: list[str]
    targets: list[dict]  # path and key column
    requested_by: str = ""
    request_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def of(cls, raw: dict) -> "ErasureRequest":
        """A request from parsed JSON; ValueError where something is missing or unknown."""
        if missing := {"subjects", "targets"} - set(raw):
            raise ValueError(f"erasure request lacks {', '.join(sorted(missing))}")
        if unknown := set(raw) - set(cls.__dataclass_fields__):
            raise ValueError(f"erasure request has unknown {', '.join(sorted(unknown))}")
        if not raw["subjects"] or any(x is None or x == "" for x in raw["subjects"]):
            raise ValueError("no subjects to erase, or an empty one")
        for t in raw["targets"]:
            if missing := {"path", "key"} - set(t):
                raise ValueError(f"erasure target lacks {', '.join(sorted(missing))}")
        return cls(**raw)


@dataclass
class ErasureReport:
    request_id: str
    results: list[dict]

    @property
    def rows_deleted(self) -> int:
        return sum(r["rows_deleted"] for r in self.results)

    @property
    def complete(self) -> bool:
        return all(r["error"] is None for r in self.results)


AUDIT = "at timestamp, request_id string, requested_by string, subjects long, path string, rows_deleted long, error string, complete boolean"


def erase(spark, request: ErasureRequest, audit_path: str | None = None) -> ErasureReport:
    """Delete the subjects' rows from each target; a target that fails doesn't keep
    the others from being erased. Each target's count is of its own commit. The audit
    is a versioned table with a row for each target; it doesn't name the subjects."""
    from lodestrata.plans.table import VersionedTable

    if not request.subjects:
        raise ValueError("no subjects to erase")
    keys = spark.createDataFrame([(str(x),) for x in request.subjects], "subject string")
    results = []
    for t in request.targets:
        try:
            table = VersionedTable(spark, t["path"])
            kind = dict(table.read().dtypes)[t["key"]]
            n = table.delete_keys(keys.select(F.col("subject").try_cast(kind)), t["key"])
            results.append({"path": t["path"], "rows_deleted": n, "error": None})
        except Exception as error:
            results.append({"path": t["path"], "rows_deleted": 0, "error": f"{type(error).__name__}: {error}"[:300]})
    report = ErasureReport(request.request_id, results)
    if audit_path:
        now = datetime.now(timezone.utc)
        rows = [(now, report.request_id, request.requested_by, len(request.subjects), r["path"], r["rows_deleted"], r["error"], report.complete) for r in results]
        VersionedTable(spark, audit_path).append(spark.createDataFrame(rows, AUDIT), (f"erasure-{report.request_id}", 0))
    return report


def without(rows: DataFrame, subjects: DataFrame, on: str) -> DataFrame:
    """Rows whose key is none of the subjects' (one column)."""
    named = subjects.select(F.col(subjects.columns[0]).alias("_gone")).distinct()
    return rows.join(named, F.col(on) == F.col("_gone"), "left_anti")
