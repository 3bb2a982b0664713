"""Monthly series and seasonal forecasts, one row per slice and candidate model.

Spark lays out slices x candidate orders as rows and spreads the fits over tasks; the
numpy helper fits one series at one order by conditional least squares.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from basketry.functions.dates import month_start
from basketry.functions.money import dbl, rounded
from basketry.functions.text import slice_key
from basketry.session import spool
from basketry.sources.star import Star

SEASON = 12
MIN_OBS = 24
MAX_HORIZON = 10
SLICE = ["category", "region_id", "region_name"]


# -------------------------------------------------------------------- series

def aggregate_series(star: Star, as_of: dt.date) -> DataFrame:
    """Monthly net revenue of completed months; months without sales are absent."""
    done = star.sales.filter(F.col("transaction_date") < F.lit(as_of.replace(day=1)))
    return done.groupBy(month_start("transaction_date").alias("month_start")).agg(
        dbl(F.sum("net_amount")).alias("net_revenue"))


def slice_series(star: Star, as_of: dt.date) -> DataFrame:
    """Monthly net revenue per slice over one common range of months, gaps as 0.0."""
    done = star.sales.filter(F.col("is_current") & (F.col("transaction_date") < F.lit(as_of.replace(day=1))))
    monthly = spool(done.groupBy(*SLICE, month_start("transaction_date").alias("month_start"))
                    .agg(dbl(F.sum("net_amount")).alias("net")), "slice-months")
    spine = monthly.select(*SLICE).distinct().select(
        *SLICE,
        monthly.agg(F.min("month_start")).scalar().alias("lo"),
        monthly.agg(F.max("month_start")).scalar().alias("hi"),
    ).select(*SLICE, F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month_start"))
    return spine.join(monthly, [*SLICE, "month_start"], "left").select(
        *SLICE, "month_start", F.coalesce("net", F.lit(0.0)).alias("net_revenue"))


def observation_gate(series: DataFrame, min_obs: int = MIN_OBS) -> DataFrame:
    """Slices with enough months to train; zero-filled months count, and are shown apart."""
    return series.groupBy(*SLICE).agg(
        F.count("net_revenue").alias("n_obs"),
        F.count_if(F.col("net_revenue") != 0).alias("nonzero_months"),
    ).withColumn("status", F.when(F.col("n_obs") >= min_obs, "trained").otherwise("skipped"))


def seasonal_baseline(series: DataFrame, horizon: int = 12) -> DataFrame:
    """Last year's month plus the mean yearly change, with a 95 % band from its spread."""
    w = Window.partitionBy(*SLICE).orderBy("month_start")  # one row per month
    change = series.withColumn("change", F.col("net_revenue") - F.lag("net_revenue", SEASON).over(w))
    whole = Window.partitionBy(*SLICE)
    with_stats = change.select(
        "*", F.max("month_start").over(whole).alias("last"),
        F.avg("change").over(whole).alias("drift"), F.stddev_samp("change").over(whole).alias("spread"))
    two = lambda c: rounded(c, 2).cast("double")
    ahead = F.add_months("month_start", SEASON)
    point = F.col("net_revenue") + F.col("drift")
    return with_stats.filter((ahead > F.col("last")) & (ahead <= F.add_months("last", horizon))).select(
        *SLICE, ahead.alias("month_start"), two(point).alias("predicted"),
        two(point - 1.96 * F.col("spread")).alias("lower"), two(point + 1.96 * F.col("spread")).alias("upper"))


# ---------------------------------------------------------------------- fits

def _polynomials(params: np.ndarray, order: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Lag polynomials of the differenced autoregression and of the moving average."""
    p, d, q, sp, sd, sq = order
    values = iter(params)
    lag = lambda c, n: np.concatenate([[1.0], np.zeros(n - 1), [c]])
    ar = np.array([1.0])
    if p:
        ar = np.convolve(ar, lag(-next(values), 1))
    ma = np.array([1.0])
    if q:
        ma = np.convolve(ma, lag(next(values), 1))
    if sp:
        ar = np.convolve(ar, lag(-next(values), SEASON))
    if sq:
        ma = np.convolve(ma, lag(next(values), SEASON))
    for times, n in ((d, 1), (sd, SEASON)):
        if times:
            ar = np.convolve(ar, lag(-1.0, n))
    return ar, ma


def _residuals(y: np.ndarray, trials: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    """One-step errors of each row of ``trials`` (parameter vectors), run side by side."""
    polynomials = [_polynomials(t, order) for t in trials]
    shocks = np.stack([np.convolve(y, ar, "valid") for ar, _ in polynomials], axis=1)
    ma = np.stack([m for _, m in polynomials], axis=1)
    lags = [i for i in range(1, len(ma)) if ma[i].any()]
    for t in range(len(shocks) if lags else 0):
        for i in lags:
            if t >= i:
                shocks[t] -= ma[i] * shocks[t - i]
    return shocks


def _errors_of(y: np.ndarray, params: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    return _residuals(y, params[None, :], order)[:, 0]


def fit_one(y: np.ndarray, order: tuple[int, ...]) -> tuple[float, list[float], float] | None:
    """(AIC, parameters, innovation variance) of one order, or None when it cannot be fitted."""
    k = order[0] + order[2] + order[3] + order[5]
    params = np.full(k, 0.1)
    if len(y) - len(_polynomials(params, order)[0]) + 1 < k + SEASON:
        return None
    e = _errors_of(y, params, order)
    damping = 1e-3
    for _ in range(25 if k else 0):
        jac = (_residuals(y, params + 1e-5 * np.eye(k), order) - e[:, None]) / 1e-5
        normal = jac.T @ jac
        step = np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-12), -jac.T @ e)
        trial = np.clip(params + step, -0.98, 0.98)
        trial_e = _errors_of(y, trial, order)
        if not np.all(np.isfinite(trial_e)) or trial_e @ trial_e >= e @ e:
            damping *= 10
            if damping > 1e6:
                break
            continue
        done = e @ e - trial_e @ trial_e < 1e-9 * (e @ e)
        params, e, damping = trial, trial_e, damping / 3
        if done:
            break
    n, variance = len(e), float(e @ e) / len(e)
    if not np.isfinite(variance) or variance <= 0:
        return None
    return n * (np.log(2 * np.pi * variance) + 1) + 2 * (k + 1), [float(v) for v in params], variance


def project(y: np.ndarray, params: np.ndarray, order: tuple[int, ...], variance: float, horizon: int):
    """Means and standard errors of the next ``horizon`` months."""
    ar, ma = _polynomials(params, order)
    e = _errors_of(y, params, order)
    values, shocks = list(y), [0.0] * (len(y) - len(e)) + list(e)
    weights = [1.0]
    for h in range(horizon):
        t = len(y) + h
        mean = -sum(c * values[t - i] for i, c in enumerate(ar) if i)
        mean += sum(c * shocks[t - i] for i, c in enumerate(ma) if i and t - i < len(y))
        values.append(mean)
        nxt = (ma[h + 1] if h + 1 < len(ma) else 0.0) - sum(ar[i] * weights[h + 1 - i] for i in range(1, min(h + 1, len(ar) - 1) + 1))
        weights.append(nxt)
    errors = np.sqrt(variance * np.cumsum(np.square(weights[:horizon])))
    return values[len(y):], errors


ORDER = ["p", "d", "q", "sp", "sd", "sq"]


def _fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            order = tuple(int(getattr(row, c)) for c in ORDER)
            try:
                fitted = fit_one(np.asarray(row.y, dtype=float), order)
            except (np.linalg.LinAlgError, FloatingPointError, ValueError):
                fitted = None
            aic, params, variance = fitted if fitted else (None, None, None)
            out.append((row.slice_id, *order, aic, params, variance))
        yield pd.DataFrame(out, columns=["slice_id", *ORDER, "aic", "params", "variance"])


def series_arrays(series: DataFrame) -> DataFrame:
    """One row per slice with its values in month order; a series has one value per month."""
    points = F.array_sort(F.collect_list(F.struct("month_start", "net_revenue")))
    return series.groupBy("slice_id").agg(points.alias("pts")).select(
        "slice_id", F.col("pts.net_revenue").alias("y"), F.element_at("pts", -1).getField("month_start").alias("last"))


def order_grid(arrays: DataFrame) -> DataFrame:
    """Every slice at each of the 64 candidate orders, fitted."""
    grid = arrays.select("slice_id", "y")
    for c in ORDER:
        grid = grid.withColumn(c, F.explode(F.array(F.lit(0), F.lit(1))))
    schema = "slice_id string, p int, d int, q int, sp int, sd int, sq int, aic double, params array<double>, variance double"
    # The rows are few but each is slow, so their number of tasks follows the cores, not
    # the bytes; a given number also keeps AQE from joining these small partitions.
    spark = arrays.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return grid.repartition(tasks, "slice_id", *ORDER).mapInPandas(_fit_rows, schema)


def best_orders(fits: DataFrame) -> DataFrame:
    """Lowest AIC per slice; a slice none of whose candidates could be fitted drops out."""
    pick = F.min_by(F.struct(*ORDER, "aic", "params", "variance"), F.struct("aic", *ORDER))
    return fits.filter("aic is not null").groupBy("slice_id").agg(pick.alias("best")).select("slice_id", "best.*")


def _project_rows(horizon: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                order = tuple(int(getattr(row, c)) for c in ORDER)
                y, params = np.asarray(row.y, dtype=float), np.asarray(row.params, dtype=float)
                means, errors = project(y, params, order, row.variance, horizon)
                for h, (m, s) in enumerate(zip(means, errors), start=1):
                    out.append((row.slice_id, h, float(m), float(m - 1.959964 * s), float(m + 1.959964 * s)))
            yield pd.DataFrame(out, columns=["slice_id", "step", "predicted", "lower", "upper"])
    return run


def _error_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            order = tuple(int(getattr(row, c)) for c in ORDER)
            e = _errors_of(np.asarray(row.y, dtype=float), np.asarray(row.params, dtype=float), order)
            out.append((row.slice_id, float(np.sqrt(np.mean(e ** 2))), float(np.mean(np.abs(e)))))
        yield pd.DataFrame(out, columns=["slice_id", "rmse", "mae"])


def check_horizon(horizon: int) -> int:
    if not 1 <= int(horizon) <= MAX_HORIZON:
        raise ValueError(f"horizon must be from 1 to {MAX_HORIZON} months")
    return int(horizon)


def forecast_ci(arrays: DataFrame, models: DataFrame, horizon: int = 3) -> DataFrame:
    """Mean and 95 % interval per slice and month ahead, rounded to cents."""
    steps = check_horizon(horizon)
    points = arrays.join(models, "slice_id").mapInPandas(
        _project_rows(steps), "slice_id string, step int, predicted double, lower double, upper double")
    month = F.add_months("last", F.col("step"))
    two = lambda c: rounded(F.col(c), 2).cast("double")
    return points.join(arrays.select("slice_id", "last"), "slice_id").select(
        "slice_id", F.year(month).alias("year"), F.month(month).alias("month"),
        two("predicted").alias("predicted_net_revenue"), two("lower").alias("lower"), two("upper").alias("upper"))


def fit_metrics(arrays: DataFrame, models: DataFrame) -> DataFrame:
    """In-sample error and chosen order per slice."""
    errors = arrays.join(models, "slice_id").mapInPandas(_error_rows, "slice_id string, rmse double, mae double")
    text = lambda *c: F.concat_ws(",", *[F.col(x).cast("string") for x in c])
    return models.join(errors, "slice_id").select(
        "slice_id", text("p", "d", "q").alias("order"), text("sp", "sd", "sq").alias("seasonal_order"),
        rounded(F.col("aic"), 4).cast("double").alias("aic"), rounded(F.col("rmse"), 4).cast("double").alias("rmse"),
        rounded(F.col("mae"), 4).cast("double").alias("mae"))


# ------------------------------------------------------------------ pipelines

def with_slice_id(series: DataFrame) -> DataFrame:
    return series.withColumn("slice_id", slice_key("category", "region_id"))


def fitted_slices(star: Star, as_of: dt.date, min_obs: int = MIN_OBS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gate, series arrays of the slices that pass, all their fits), fits written once."""
    series = with_slice_id(slice_series(star, as_of))
    gate = with_slice_id(observation_gate(series, min_obs))
    arrays = series_arrays(series).join(gate.filter("status = 'trained'").select("slice_id"), "slice_id", "left_semi")
    arrays = spool(arrays, "series")
    return gate, arrays, spool(order_grid(arrays), "fits")


def aggregate_forecast(star: Star, as_of: dt.date, horizon: int = 3) -> DataFrame:
    arrays = spool(series_arrays(aggregate_series(star, as_of).withColumn("slice_id", F.lit("all"))), "series")
    return forecast_ci(arrays, best_orders(order_grid(arrays)), horizon).drop("slice_id").orderBy("year", "month")


def slice_forecast(gate: DataFrame, arrays: DataFrame, models: DataFrame, horizon: int = 3,
                   category: str | None = None, region: str | None = None) -> DataFrame:
    """Forecast rows of the slices that match the filters."""
    from basketry.functions.text import same_text

    wanted = gate
    if category is not None:
        wanted = wanted.filter(same_text("category", category))
    if region is not None:
        wanted = wanted.filter(same_text("region_name", region) | same_text("region_id", region))
    return forecast_ci(arrays, models, horizon).join(wanted.select("slice_id", *SLICE), "slice_id")


def forecast_totals(rows: DataFrame) -> DataFrame:
    """Sums over slices per month; the bounds are summed as they are."""
    total = lambda c: dbl(F.sum(F.col(c).cast("decimal(20,2)"))).alias(c)
    return rows.groupBy("year", "month").agg(
        total("predicted_net_revenue"), total("lower"), total("upper")).orderBy("year", "month")


def manifest(gate: DataFrame, arrays: DataFrame, models: DataFrame) -> DataFrame:
    """Every slice with its outcome: trained with order and errors, skipped or failed."""
    metrics = fit_metrics(arrays, models)
    status = F.when(F.col("status") == "skipped", "skipped").when(F.col("order").isNull(), "failed").otherwise("trained")
    return gate.join(metrics, "slice_id", "left").withColumn("status", status)
