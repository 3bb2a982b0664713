"""Calendar expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from basketry.functions.money import col

# First month*100+day of each season; Winter wraps the year end.
SEASON_STARTS = {"Spring": 320, "Summer": 621, "Fall": 923, "Winter": 1221}
SEASON_ORDER = {"Spring": 1, "Summer": 2, "Fall": 3, "Winter": 4}
# Holidays beside weekends, as month*100+day.
FIXED_HOLIDAYS = (101, 1126, 1225)


def month_day(d: Column | str) -> Column:
    return F.month(col(d)) * 100 + F.dayofmonth(col(d))


def season(d: Column | str) -> Column:
    md = month_day(d)
    s = SEASON_STARTS
    return (
        F.when((md >= s["Spring"]) & (md < s["Summer"]), "Spring")
        .when((md >= s["Summer"]) & (md < s["Fall"]), "Summer")
        .when((md >= s["Fall"]) & (md < s["Winter"]), "Fall")
        .otherwise("Winter")
    )


def is_holiday(d: Column | str) -> Column:
    return (F.weekday(col(d)) >= 5) | month_day(d).isin(*FIXED_HOLIDAYS)


def month_start(d: Column | str) -> Column:
    return F.trunc(col(d), "MM")


def fiscal_quarter(month: Column | str) -> Column:
    return F.ceil(col(month) / F.lit(3)).cast("int")


def shifted_month(d: Column | str, months: int) -> Column:
    """First day of the month ``months`` away."""
    return F.add_months(month_start(d), months)


def month_windows(month: Column | str, back: int = 36) -> list[Column]:
    """Bounds of a month and of the history window that ends with it."""
    first = month_start(month)
    return [
        first.alias("month_start"),
        F.last_day(first).alias("month_end"),
        F.add_months(first, -1).alias("previous_month"),
        F.add_months(first, 1).alias("next_month"),
        F.add_months(first, -back).alias("history_start"),
        F.size(F.sequence(F.add_months(first, -back), F.add_months(first, -1), F.expr("interval 1 month"))).alias("history_months"),
    ]
