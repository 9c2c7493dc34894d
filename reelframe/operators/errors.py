"""Errors as data: a value and a nullable error_code (null or 0 is success)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_ok(code: Column) -> Column:
    return F.coalesce(code, F.lit(0)) == 0


def map_value(value: Column, code: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(is_ok(code), f(value))


def map_error(code: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(is_ok(code), code).otherwise(f(code))


def and_then(value: Column, code: Column, f: Callable[[Column], tuple[Column, Column]]) -> tuple[Column, Column]:
    """(value, code) of f where there is no error yet, else the error."""
    v, c = f(value)
    return F.when(is_ok(code), v), F.when(is_ok(code), c).otherwise(code)


def unwrap_or(value: Column, code: Column, default) -> Column:
    return F.when(is_ok(code), value).otherwise(F.lit(default))


def band(code: Column) -> Column:
    """success, common, io, format, codec, frame, or null beyond them."""
    from reelframe.catalog import BANDS

    return F.when(is_ok(code), BANDS[0]).otherwise(F.get(F.array(*(F.lit(b) for b in BANDS)), F.floor(code / 1000).cast("int")))


def counts(df: DataFrame, code: str = "error_code") -> DataFrame:
    return df.groupBy(F.coalesce(code, F.lit(0)).alias(code)).agg(F.count(F.lit(1)).alias("n"))
