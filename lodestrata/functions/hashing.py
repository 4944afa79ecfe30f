"""Keyed tokens and row fingerprints as expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

_BLOCK = 64


def hmac_sha256(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex of a string or binary column; null stays null. Composed
    of sha2, so it runs inside generated code."""
    padded = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in padded)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def business_columns(df: DataFrame) -> list[str]:
    """Columns that describe the entity: all but those led by an underscore, in order of name."""
    return sorted(c for c in df.columns if not c.startswith("_"))


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A 64-bit fingerprint of the business columns. Null, the empty string and
    values of other types that print alike give different fingerprints."""
    parts: list[Column] = []
    for name in columns or business_columns(df):
        parts += [F.col(f"`{name}`").isNull(), F.col(f"`{name}`")]
    return F.xxhash64(*parts)
