"""Small helpers for Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: it becomes the variable of a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def required(ok: Column, value: Column, message: str | Column) -> Column:
    """value where ok holds, an error elsewhere; null counts as not holding."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(ok, value).otherwise(F.raise_error(text))


def ascending(lo: Column, hi: Column) -> Column:
    """lo, lo + 1, ..., hi - 1 as an array, empty if hi <= lo (sequence() alone would count down)."""
    return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))


def total(items: Column, value: Callable[[Column], Column], zero: Column | None = None) -> Column:
    """The sum of value over an array; 0 for an empty one."""
    return F.aggregate(items, F.lit(0).cast("bigint") if zero is None else zero, lambda acc, x: acc + value(x))
