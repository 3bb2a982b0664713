"""Series, fits and training rows."""
import datetime as dt
import hashlib
import inspect
import itertools
from weakref import WeakKeyDictionary

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.plans import boosting, demand as M, features as X, forecast as T
from basketry.registry import models
from basketry.sources.star import load_star


def monthly(spark, series):
    rows = []
    for name, values in series.items():
        for i, v in enumerate(values):
            rows.append((name, "R", "Region", dt.date(1995 + i // 12, i % 12 + 1, 1), float(v)))
    return spark.createDataFrame(rows, "category string, region_id string, region_name string, month_start date, net_revenue double")


def test_fit_recovers_known_coefficients():
    rng = np.random.default_rng(0)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    assert T.fit_one(y, (1, 0, 0, 0, 0, 0))[1][0] == pytest.approx(0.7, abs=0.1)
    e = rng.normal(size=400)
    y = e.copy()
    y[1:] += 0.5 * e[:-1]
    assert T.fit_one(y, (0, 0, 1, 0, 0, 0))[1][0] == pytest.approx(0.5, abs=0.12)


def test_random_walk_projection_is_flat_with_growing_errors():
    y = np.array([3.0, 5.0, 4.0])
    means, errors = T.project(y, np.array([]), (0, 1, 0, 0, 0, 0), 4.0, 3)
    assert means == [4.0] * 3 and errors == pytest.approx(2 * np.sqrt([1, 2, 3]))


def test_constant_series_and_short_series_cannot_be_fitted():
    assert T.fit_one(np.zeros(60), (1, 0, 0, 0, 0, 0)) is None
    assert T.fit_one(np.arange(10.0), (1, 1, 1, 1, 1, 1)) is None


def test_forecast_follows_trend_and_season(spark):
    rng = np.random.default_rng(1)
    t = np.arange(84)
    truth = lambda x: 1000 + 5 * x + 100 * np.sin(2 * np.pi * x / 12)
    df = T.with_slice_id(monthly(spark, {"wave": truth(t) + rng.normal(size=84)}))
    arrays = T.series_arrays(df)
    models = T.best_orders(T.order_grid(arrays))
    rows = T.forecast_ci(arrays, models, 6).orderBy("year", "month").collect()
    assert [(r.year, r.month) for r in rows] == [(2002, m) for m in range(1, 7)]
    assert [r.predicted_net_revenue for r in rows] == pytest.approx(list(truth(np.arange(84, 90))), abs=15)
    assert all(r.lower < r.predicted_net_revenue < r.upper for r in rows)
    assert T.fit_metrics(arrays, models).first().rmse < 10


def test_gate_and_manifest(spark):
    rng = np.random.default_rng(2)
    series = T.with_slice_id(monthly(spark, {"long": 100 + rng.normal(size=48), "short": [1.0] * 23, "flat": [0.0] * 48}))
    gate = T.with_slice_id(T.observation_gate(series))
    arrays = T.series_arrays(series).join(gate.filter("status = 'trained'").select("slice_id"), "slice_id", "left_semi")
    out = T.manifest(gate, arrays, T.best_orders(T.order_grid(arrays)))
    assert {r.category: r.status for r in out.collect()} == {"long": "trained", "short": "skipped", "flat": "failed"}


def test_grid_has_64_candidates_per_slice(spark):
    arrays = T.series_arrays(T.with_slice_id(monthly(spark, {"a": np.random.default_rng(3).normal(size=40)})))
    rows = T.order_grid(arrays).select(*T.ORDER).collect()
    assert sorted(tuple(r) for r in rows) == sorted(itertools.product((0, 1), repeat=6))


def test_horizon_is_held_to_ten():
    assert [T.check_horizon(h) for h in (1, 10)] == [1, 10]
    for bad in (0, 11, 99):
        with pytest.raises(ValueError):
            T.check_horizon(bad)


def rows_of(spark, n):
    data = [(f"t{i}", dt.date(2026, 1, 1) + dt.timedelta(days=i % 50), float(i % 37), "new" if i % 5 == 0 else "historical") for i in range(n)]
    return spark.createDataFrame(data, "transaction_id string, transaction_date date, net_amount double, source string")


def test_weights_halve_and_new_rows_weigh_most(spark):
    df = spark.createDataFrame([("historical", dt.date(2026, 1, 1)), ("historical", dt.date(2025, 7, 5)), ("new", dt.date(2025, 7, 5))],
                               "source string, transaction_date date")
    assert [r.sample_weight for r in X.decay_weight(df).collect()] == pytest.approx([1.0, 0.5, 1.0])


def test_nothing_to_train_on_is_an_error(spark):
    empty = rows_of(spark, 3).drop("source").limit(0)
    with pytest.raises(ValueError, match="no training rows"):
        X.combine(empty, empty)


def test_split_is_stratified_and_repeatable(spark):
    df = rows_of(spark, 500)
    a = X.stratified_split(df, "net_amount").select("transaction_id", "bin", "split")
    assert sorted(a.collect()) == sorted(X.stratified_split(df.repartition(5), "net_amount").select("transaction_id", "bin", "split").collect())
    shares = a.groupBy("bin").agg(F.avg((F.col("split") == "train").cast("int")).alias("s"), F.count("*").alias("n")).collect()
    assert len(shares) == 10 and all(abs(r.s - 0.8) < 1.0 / r.n for r in shares)


def test_split_is_that_of_one_order_over_each_bin(spark):
    rows = X.stratified_split(rows_of(spark, 500), "net_amount").collect()
    for b in {r.bin for r in rows}:
        inside = sorted((hashlib.md5(f"{r.transaction_id}#42".encode()).hexdigest(), r.split) for r in rows if r.bin == b)
        n = int(len(inside) * 0.8 + 1e-9)
        assert [s for _, s in inside] == ["train"] * n + ["test"] * (len(inside) - n)


def test_models_are_fitted_on_all_sales(spark):
    sf = "/root/testdata/sf0.001"
    sales = X.demand_columns(load_star(spark, sf)).filter(F.col("transaction_date") <= "2001-10-31")
    fitted = models.all_training(spark, sf)
    assert fitted.count() == sales.count() > models.training(spark, sf).count()
    scored = models.ml_train_demand(spark, sf).count()  # the test part, a fifth of all but for each bin's rounding
    assert abs(scored - 0.2 * fitted.count()) <= 10


def test_few_rows_get_fewer_bins(spark):
    assert len(X.target_bins(rows_of(spark, 12), "net_amount")) + 1 == 5
    assert X.target_bins(rows_of(spark, 3), "net_amount") is None


def test_impute(spark):
    df = spark.createDataFrame([(1.0, "x", None, None, True), (None, "x", 3, "e", None), (9.0, None, 4, None, False)],
                               "q double, c string, m int, e string, h boolean")
    fills = X.impute_values(df, ["q"], ["c"])
    got = X.impute(df, fills, ["m"], ["e"], ["h"]).collect()
    assert [tuple(r) for r in got] == [(1.0, "x", 0, "none", 1), (5.0, "x", 3, "e", 0), (9.0, "x", 4, "none", 0)]


def test_evaluate(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)], "label double, prediction double")
    r = M.evaluate(df).first()
    assert (r.rows, r.rmse, r.mae, r.r2) == (3, 1.291, 1.0, -1.5)


def test_model_learns_saves_and_never_predicts_below_zero(spark, tmp_path):
    data = [(f"t{i}", float(10 * (i % 2) - 4), 5.0 + i % 3, 0.0, "a" if i % 2 else "b", "online", False, 1.0) for i in range(120)]
    rows = spark.createDataFrame(data, "transaction_id string, net_amount double, quantity double, discount_amount double, "
                                       "category string, store_type string, is_holiday boolean, sample_weight double").withColumn("unit_price", F.lit(1.0))
    scored = M.train_and_save(rows, M.REVENUE, str(tmp_path / "m"), trees=5, depth=2)
    model = M.load(str(tmp_path / "m"))
    assert M.evaluate(scored).first().r2 > 0.9
    ranked = M.importances(spark, model, M.REVENUE).collect()
    assert ranked[0].feature.startswith("category_") and sum(r.gain for r in ranked) == pytest.approx(1.0)
    unseen = M.prepared(rows, M.REVENUE).withColumn("category", F.lit("unseen"))
    assert M.predict(model, unseen).agg(F.min("predicted_qty")).first()[0] >= 0


def test_models_are_fitted_on_small_partitions(spark, tmp_path, monkeypatch):
    """The fit reads its rows with the settings of small tasks, and the session's own are back afterwards."""
    from basketry.session import SMALL_TASKS
    before = {k: spark.conf.get(k, None) for k in SMALL_TASKS}
    seen = []

    def fitted(rows, *_):
        seen.append({k: spark.conf.get(k, None) for k in SMALL_TASKS})
        raise InterruptedError

    monkeypatch.setattr(M, "train", fitted)
    rows = spark.range(40).selectExpr(
        "concat('T', id) transaction_id", "cast(id as double) net_amount", "1 quantity", "2.0 unit_price", "0.0 discount_amount",
        "'c' category", "'online' store_type", "false is_holiday", "1.0D sample_weight")
    with pytest.raises(InterruptedError):
        M.train_and_save(rows, M.REVENUE, str(tmp_path / "model"))
    assert seen == [SMALL_TASKS] and {k: spark.conf.get(k, None) for k in SMALL_TASKS} == before


def test_models_have_as_many_trees_as_the_job_names(spark, monkeypatch):
    """400 trees of depth 6, in the registered models and by default."""
    seen = []

    def fitted(rows, spec, trees, depth):
        seen.append((spec.target, trees, depth))
        raise InterruptedError

    monkeypatch.setattr(M, "train", fitted)
    monkeypatch.setattr(models, "_memo", WeakKeyDictionary())  # models that another test has fitted are not taken
    for spec in (M.DEMAND, M.REVENUE):
        with pytest.raises(InterruptedError):
            models._model(spark, "/root/testdata/sf0.001", spec)
    assert seen == [("quantity", 400, 6), ("net_amount", 400, 6)]
    assert inspect.signature(M.train_and_save).parameters["trees"].default == 400


def boosted_rows(spark, n=400):
    rng = np.random.default_rng(5)
    x, c, w = rng.integers(0, 20, n).astype(float), rng.integers(0, 4, n), rng.uniform(0.5, 2.0, n)
    y = 3.0 * (x > 12) + 2.0 * (c == 2) + 0.1 * rng.normal(size=n)
    data = [(f"t{i}", float(x[i]), int(c[i]), float(y[i]), float(w[i])) for i in range(n)]
    return spark.createDataFrame(data, "id string, x double, c int, y double, w double"), x, c, y, w


def boosted(rows, trees, depth, **shares):
    shares = {"row_share": 1.0, "column_share": 1.0, "step": 1.0, **shares}
    model = boosting.fit(rows, [F.col("x")], [F.col("c")], [5], F.col("y"), F.col("w"), F.col("id"), trees, depth, seed=7, **shares)
    scored = rows.withColumn("p", model.predict([F.col("x")], [F.col("c")]))
    return model, np.array([r.p for r in scored.orderBy(F.expr("cast(substr(id, 2) as int)")).collect()])


def test_a_tree_is_that_of_all_splits_compared(spark):
    """Depth 2 against a plain search over every split of every encoded column."""
    rows, x, c, y, w = boosted_rows(spark)
    columns = [x > e for e in np.unique(x)] + [c == k for k in range(5)]
    out = np.full(len(y), (w * y).sum() / w.sum())
    rest = y - out
    score = lambda m: (w * rest)[m].sum() ** 2 / (w[m].sum() + 1)

    def best(m):
        right = max((k for k in columns if min(w[m & k].sum(), w[m & ~k].sum()) >= 1), key=lambda k: score(m & k) + score(m & ~k))
        return m & ~right, m & right

    for half in best(np.ones(len(y), bool)):
        for leaf in best(half):
            out[leaf] += (w * rest)[leaf].sum() / (w[leaf].sum() + 1)
    model, got = boosted(rows, 1, 2)
    assert got == pytest.approx(out, abs=1e-4)
    assert len(model.trees) == 1 and all(g >= 0 for g in model.gains) and sum(model.gains) > 0


def test_a_fit_does_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    """Shares of rows and columns, states written between trees, several blocks a task."""
    monkeypatch.setattr(boosting, "WRITTEN_EVERY", 3)
    rows, *_, y, _ = boosted_rows(spark)
    kinds = {"row_share": 0.9, "column_share": 0.9, "step": 0.3}
    _, one = boosted(rows.repartition(1), 12, 3, **kinds)
    _, many = boosted(rows.repartition(9, "x"), 12, 3, **kinds)
    assert one == pytest.approx(many, abs=1e-3) and np.mean((one - y) ** 2) < 0.05 * np.var(y)


def test_a_fit_holds_few_bytes_a_row(spark):
    """Coded rows, not encoded vectors: 590 bytes a row were kept before."""
    c = boosting.Coding([[0.0] * 255, [0.0] * 255, [0.0] * 10, [0.0] * 11, [0.0] * 3, [0.0]], [6, 26, 3, 5, 4])
    block = boosting.Block(c.codes([np.zeros(1000)] * 11), *[np.zeros(1000, t) for t in (np.float32, np.float32, np.uint32, bool)])
    assert sum(map(len, boosting._packed(block))) <= 30 * 1000


def test_rows_without_a_label_cannot_be_fitted(spark):
    rows, *_ = boosted_rows(spark, 20)
    with pytest.raises(ValueError, match="no label"):
        boosted(rows.withColumn("y", F.when(F.col("id") != "t3", F.col("y"))), 1, 1)
