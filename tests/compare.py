"""Rows of a Spark query and of its SQL, in a form that can be compared."""


import pandas as pd


def plain(value):
    if pd.isna(value):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in row) for row in frame[names].astype(object).itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))


def assert_same(spark_frame, sql_frame) -> None:
    left, right = spark_frame.toPandas(), sql_frame
    assert sorted(left.columns) == sorted(right.columns)
    assert rows(left) == rows(right)
