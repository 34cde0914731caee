"""List and struct patterns of rule bodies, guarded so that no element is read that isn't there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_nil(xs: Column) -> Column:
    return F.size(xs) == 0


def is_cons(xs: Column) -> Column:
    return F.size(xs) > 0


def head(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def tail(xs: Column) -> Column:
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(0)))


def at_least(xs: Column, n: int) -> Column:
    """Pattern [X1, .., Xn | L]."""
    return F.size(xs) >= n


def exactly(xs: Column, n: int) -> Column:
    return F.size(xs) == n


def truncating_div(a: Column, b: Column) -> Column:
    """Integer division toward zero, exact for every long."""
    return F.call_function("div", a, b)


def remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend."""
    return a % b
