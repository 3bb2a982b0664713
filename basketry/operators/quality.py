"""Row rules of the canonical contract; every failed rule of a row is reported."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from basketry.functions.dates import month_start
from basketry.operators.adapter import CANONICAL

NULLABLE = {"discount_amount"}


def _value_checks(now: dt.datetime) -> dict[str, tuple[str, Column]]:
    """Column -> (name, failing condition). NULL never fails a value check."""
    return {
        "txn_timestamp": ("txn_timestamp_in_future", F.col("txn_timestamp") > F.lit(now + dt.timedelta(days=1))),
        "quantity": ("quantity_not_positive", F.col("quantity") <= 0),
        "unit_price": ("unit_price_negative", F.col("unit_price") < 0),
        "discount_amount": ("discount_negative", F.col("discount_amount") < 0),
    }


def _failures(now: dt.datetime, df: DataFrame | None = None) -> list[tuple[str, Column]]:
    """(``column:check``, condition that is true for a bad row), in contract order.

    A record that did not fit its feed's schema, where ``df`` tells, fails ``record:corrupt`` first.
    """
    checks = _value_checks(now)
    found = [("record:corrupt", F.col("raw_line").isNotNull())] if df is not None and "raw_line" in df.columns else []
    for name in CANONICAL:
        if name not in NULLABLE:
            found.append((f"{name}:not_nullable", F.col(name).isNull()))
        if name in checks:
            check_name, fails = checks[name]
            found.append((f"{name}:{check_name}", fails))
    return found


def reject_reason(now: dt.datetime, df: DataFrame | None = None) -> Column:
    """Every failed rule of the row, ``; `` between them; NULL for a valid row."""
    texts = [F.when(fails, F.lit(rule)) for rule, fails in _failures(now, df)]
    return F.nullif(F.concat_ws("; ", *texts), F.lit(""))


def is_rejected(now: dt.datetime, df: DataFrame | None = None) -> Column:
    bad = F.lit(False)
    for _, fails in _failures(now, df):
        bad = bad | F.coalesce(fails, F.lit(False))
    return bad


def check(df: DataFrame, now: dt.datetime) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(now, df))


def valid(df: DataFrame, now: dt.datetime) -> DataFrame:
    return df.filter(~is_rejected(now, df))


def rejected(df: DataFrame, now: dt.datetime) -> DataFrame:
    """Bad rows with their reason, which is only put together for them."""
    return check(df.filter(is_rejected(now, df)), now)


def split(df: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    return valid(df, now), rejected(df, now)


def failed_rules(df: DataFrame, now: dt.datetime) -> DataFrame:
    """How many rows fail each rule, in one pass and one output row per failed rule."""
    rules = _failures(now, df)
    counts = df.agg(*[F.count_if(fails).alias(rule) for rule, fails in rules])
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("rows")) for rule, _ in rules])
    return counts.select(F.inline(pairs)).filter("rows > 0")


def flag_sku_unmatched(df: DataFrame, product: DataFrame) -> DataFrame:
    """Mark rows whose SKU is not a known product; they are kept."""
    known = product.select(F.col("sku_id").alias("sku")).distinct().withColumn("_known", F.lit(True))
    return (
        df.join(known, "sku", "left").withColumn("sku_unmatched", F.col("_known").isNull()).drop("_known")
    )


def flag_late(df: DataFrame, batch_month: Column) -> DataFrame:
    """Late means dated in a month before the batch month."""
    return df.withColumn("late_arrival", month_start("txn_timestamp") < batch_month)
