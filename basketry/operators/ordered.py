"""Exact order statistics without an unpartitioned window.

A running total over a whole table normally needs one task that sees every row.
Here the rows are first counted per distinct value, values are cut into buckets at
approximate quantiles, each bucket runs its own window, and the (few) bucket totals
give every bucket its offset.  Bucket edges only decide how work is split, never the
result, so approximate edges still give exact totals.
"""
from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.session import spool

#: Buckets per task slot of the cluster; a bucket is one window's work.
BUCKETS_PER_SLOT = 4


def with_bucket(values: DataFrame, value: str, buckets: int) -> DataFrame:
    """Add ``_bucket``, rising with the value; ``value`` must not be NULL.

    The edges are plain numbers, so every use of the frame, and every retried task, cuts
    at the same places.
    """
    cuts = [i / buckets for i in range(1, buckets)]
    point = F.col(value).cast("double")
    edges = values.agg(F.percentile_approx(point, cuts, max(1000, buckets * 20))).first()[0] or [0.0]  # any edge will do
    splits = [float("-inf"), *sorted({float(e) for e in edges}), float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="_point", outputCol="_at")
    return (
        cutter.transform(values.withColumn("_point", point))
        .withColumn("_bucket", F.col("_at").cast("int")).drop("_point", "_at")
    )


def running_totals(
    values: DataFrame,
    value: str,
    measures: list[str],
    by: list[str] | None = None,
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``<measure>_upto`` (inclusive) and ``<measure>_all`` in ``value`` order.

    ``values`` must hold one row per (by, value), with no NULL value.  There are as many buckets as
    the cluster's parallelism asks for, and every table takes this one path.
    """
    by = by or []
    order = F.col(value).desc() if descending else F.col(value).asc()
    values = spool(values, "values")
    buckets = buckets or max(2, BUCKETS_PER_SLOT * values.sparkSession.sparkContext.defaultParallelism)
    bucketed = with_bucket(values, value, buckets)

    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = bucketed.select(
        "*", *[F.sum(m).over(inside).alias(f"_{m}_in") for m in measures]
    )

    # One row per (by, bucket): at most `buckets` rows per group.
    sums = bucketed.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = Window.partitionBy(*by).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sums.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}_before") for m in measures],
        *[F.sum(f"_{m}").over(whole).alias(f"{m}_all") for m in measures],
    )
    joined = local.join(offsets, [*by, "_bucket"])
    return joined.select(
        *values.columns,
        *[(F.col(f"_{m}_in") + F.col(f"_{m}_before")).alias(f"{m}_upto") for m in measures],
        *[F.col(f"{m}_all") for m in measures],
    )


def exact_medians(df: DataFrame, by: list[str], measures: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """Median of every measure per group, mean of the middle two for even counts.

    All measures are counted per distinct value in one pass over ``df``.
    """
    pairs = F.array(*[
        F.struct(F.lit(name).alias("_measure"), c.cast("double").alias("_value"))
        for name, c in measures.items()
    ])
    counts = (
        df.select(*by, F.inline(pairs)).filter("_value is not null")
        .groupBy(*by, "_measure", "_value").agg(F.count("*").alias("n"))
    )
    ranked = running_totals(counts, "_value", ["n"], [*by, "_measure"], buckets=buckets)
    first, last = F.col("n_upto") - F.col("n") + 1, F.col("n_upto")
    lower = F.floor((F.col("n_all") + 1) / 2)
    upper = F.floor((F.col("n_all") + 2) / 2)
    at = lambda name, pos: F.max(
        F.when((F.col("_measure") == name) & pos.between(first, last), F.col("_value")))
    return ranked.groupBy(*by).agg(*[
        ((at(name, lower) + at(name, upper)) / 2).cast("decimal(38,6)").cast("double").alias(name)
        for name in measures
    ])


def ranked_values(df: DataFrame, value: Column, buckets: int | None = None) -> DataFrame:
    """Distinct non-NULL values with their count ``n``, ``n_upto`` (inclusive) and ``n_all``, written down."""
    counts = df.select(value.cast("double").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return spool(running_totals(counts, "value", ["n"], buckets=buckets), "ranked")


def quantiles(ranked: DataFrame, shares: list[float]) -> tuple[int, dict[float, float]]:
    """How many rows, and the exact quantile of every share, interpolated between neighbours.

    Every position is picked from the running totals by one aggregate, whatever the number of
    shares; no task holds more than the buckets of ``running_totals`` give it.
    """
    last = F.col("n_all") - 1
    picks = []
    for i, share in enumerate(shares):
        place = last * F.lit(float(share))  # counted from 0
        for name, at in (("low", F.floor(place)), ("high", F.ceil(place))):
            here = (at >= F.col("n_upto") - F.col("n")) & (at < F.col("n_upto"))
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"{name}{i}"))
    got = ranked.agg(F.max("n_all").alias("n"), *picks).first()
    n, out = got["n"] or 0, {}
    for i, share in enumerate(shares if n else []):
        place, low, high = (n - 1) * float(share), got[f"low{i}"], got[f"high{i}"]
        below, above = math.floor(place), math.ceil(place)
        out[share] = low if below == above or low == high else (above - place) * low + (place - below) * high
    return n, out


def modes(df: DataFrame, by: list[str], value: Column, name: str, weight: Column | None = None) -> DataFrame:
    """Most frequent value per group; ties go to the smallest value."""
    weight = F.lit(1) if weight is None else weight
    counts = (
        df.select(*by, value.alias("_v"), weight.alias("_w")).filter("_v is not null")
        .groupBy(*by, "_v").agg(F.sum("_w").alias("_n"))
    )
    return counts.groupBy(*by).agg(F.min(F.struct(-F.col("_n"), F.col("_v").alias("_v"))).getField("_v").alias(name))
