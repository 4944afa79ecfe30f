"""Clustering expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def bucket(column: str, bounds: list[float]) -> Column:
    """How many of the ascending bounds lie below the value (null: 0)."""
    if not bounds:
        return F.lit(0)
    hits = [F.when(F.col(column) > b, 1).otherwise(0) for b in bounds]
    return reduce(lambda a, b: a + b, hits)


def interleaved(buckets: list[Column], bits: int) -> Column:
    """The Morton number of bucket numbers of `bits` bits each."""
    out = F.lit(0).cast("long")
    for bit in range(bits):
        for k, b in enumerate(buckets):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(b.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")), bit * len(buckets) + k))
    return out


def z_value(df: DataFrame, columns: list[str], bits: int = 4, error: float = 0.01) -> Column:
    """The Morton number of the columns' quantile buckets. Strings, dates and
    timestamps are bucketed by a monotone number of theirs."""
    kinds = dict(df.dtypes)

    def number(name: str) -> Column:
        c = F.col(f"`{name}`")
        if kinds[name] == "string":
            return F.conv(F.rpad(F.hex(F.substring(c, 1, 6)), 12, "0"), 16, 10).cast("double")
        if kinds[name].startswith(("timestamp", "date")):
            return F.unix_micros(c.cast("timestamp")).cast("double")
        return c.cast("double")

    numbered = df.select(*(number(c).alias(f"_z{i}") for i, c in enumerate(columns)))
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    bounds = numbered.approxQuantile([f"_z{i}" for i in range(len(columns))], steps, error)
    parts = []
    for name, found in zip(columns, bounds):
        hits = [F.when(number(name) > b, 1).otherwise(0) for b in found]
        parts.append(reduce(lambda a, b: a + b, hits, F.lit(0)))
    return interleaved(parts, bits)
