"""Sessions with the settings the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_SHIPPED: set[str] = set()


def session(app: str = "lodestrata", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew splitting, ANSI semantics."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.redaction.string.regex": "(?i)secret|pepper|token_key",
    }
    for name, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def instant(column: str) -> Column:
    """A timestamp without zone as an instant (UTC), which watermarks and epoch functions need."""
    return F.col(column).cast("timestamp")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A temporary one is
    named where the session has none and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their
    workers can import it wherever it is installed on the driver only."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), "lodestrata_pkg.zip")  # read by the driver only, which serves it
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
