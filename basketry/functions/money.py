"""Exact money arithmetic: sums stay decimal, outputs become double.

A double is never rounded directly and two decimals are never divided: both lose
digits differently from engine to engine.  ``ratio`` divides as double, fixes ten
decimals, then rounds half-up.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(12,2)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def big(c: Column | str) -> Column:
    return col(c).cast("bigint")


def rounded(c: Column, digits: int) -> Column:
    return F.round(c.cast("decimal(38,10)"), digits)


def ratio(num: Column | str, den: Column | str, digits: int) -> Column:
    """num/den rounded to ``digits``; NULL when the denominator is 0 or NULL."""
    return rounded(F.try_divide(dbl(num), dbl(den)), digits).cast("double")


def sum_of(c: Column | str) -> Column:
    return dbl(F.sum(col(c)))


def count_of(c: Column | str = "transaction_id") -> Column:
    return big(F.count(col(c)))


def cents(c: Column | str) -> Column:
    """A two-decimal amount as whole cents."""
    return F.round(col(c).cast("decimal(14,2)") * 100, 0).cast("bigint")


def discount_band(total: Column | str = "total_amount", discount: Column | str = "discount_amount") -> Column:
    """Band of discount/total, compared by exact decimal multiplication, not division."""
    t, d = col(total), col(discount)
    return (
        F.when((t == 0) | (d == 0), "0%")
        .when(d < t * F.lit("0.10").cast("decimal(3,2)"), "0-10%")
        .when(d < t * F.lit("0.20").cast("decimal(3,2)"), "10-20%")
        .otherwise("20%+")
    )


# Band order and the rate that stands for each band.
BAND_ORDER = {"0%": 0, "0-10%": 1, "10-20%": 2, "20%+": 3}
BAND_MIDPOINT = {"0%": 0.0, "0-10%": 0.05, "10-20%": 0.15, "20%+": 0.25}


def lookup(c: Column | str, table: dict, default) -> Column:
    """Small constant lookup as a CASE ladder."""
    out = None
    for key, value in table.items():
        out = F.when(col(c) == key, F.lit(value)) if out is None else out.when(col(c) == key, F.lit(value))
    return out.otherwise(F.lit(default))
