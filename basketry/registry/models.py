"""Training features, models, series and forecasts."""
from __future__ import annotations

import datetime as dt
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, functions as F

from basketry.functions.money import big, dbl, rounded
from basketry.plans import demand as M, features as X, forecast as T
from basketry.registry.query import Query
from basketry.registry.star_sql import dbl as sql_dbl, big as sql_big, ratio, star
from basketry.session import small_tasks, spool
from basketry.sources.star import load_star, sales_star, session_folder

AS_OF = dt.date(2001, 10, 20)
TREES, DEPTH = 400, 6

_memo: WeakKeyDictionary = WeakKeyDictionary()


def once(spark: SparkSession, key: tuple, make):
    """Sampled rows, models and fits are shared by the queries of one session."""
    kept = _memo.setdefault(spark, {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def training(spark, sf_dir) -> DataFrame:
    """The bounded extract, which the feature queries show."""
    return once(spark, ("rows", sf_dir), lambda: spool(X.training_rows(load_star(spark, sf_dir), AS_OF), "training"))


def all_training(spark, sf_dir) -> DataFrame:
    """Every sale up to the month of ``AS_OF``, which the models are fitted on."""
    return once(spark, ("all rows", sf_dir), lambda: spool(
        X.training_rows(load_star(spark, sf_dir), AS_OF, cap=None, months=None, per_month=None), "all-training"))


def _model(spark, sf_dir, spec: M.ModelSpec):
    def make():
        path = f"{session_folder(spark, sf_dir)}/model-{spec.target}"
        scored = M.train_and_save(all_training(spark, sf_dir), spec, path, TREES, DEPTH)
        return M.load(path), spool(scored.select("transaction_id", "label", "prediction"), "scored")
    return once(spark, ("model", spec.target, sf_dir), make)


def _fits(spark, sf_dir):
    def make():
        with small_tasks(spark):  # the series are written inside
            return T.fitted_slices(sales_star(spark, sf_dir), AS_OF)
    return once(spark, ("fits", sf_dir), make)


def _slices(spark, sf_dir):
    gate, arrays, fits = _fits(spark, sf_dir)
    return gate, arrays, T.best_orders(fits)


# ------------------------------------------------------------------- features

MONEY_COLUMNS = ("unit_price", "discount_amount", "net_amount", "list_price")


def shown(rows: DataFrame, *extra: str) -> DataFrame:
    names = ["transaction_id", "transaction_date", "quantity", *MONEY_COLUMNS, "discount_rate", "category", "brand", "store_type",
             "is_holiday", "season", "month", "quarter", "marketing_event", *extra]
    return rows.select(*[dbl(c).alias(c) if c in MONEY_COLUMNS else F.col(c) for c in names])


FEATURE_SQL = f"""
  SELECT transaction_id, transaction_date, quantity, category, brand, store_type, season, month, quarter, is_holiday, marketing_event,
         {sql_dbl('unit_price')} AS unit_price, {sql_dbl('list_price')} AS list_price, {sql_dbl('discount_amount')} AS discount_amount,
         {sql_dbl('net_amount')} AS net_amount, COALESCE({ratio('discount_amount', 'total_amount', 6)}, 0) AS discount_rate
  FROM live_sales"""
TRAINING = f"""feature_rows AS ({FEATURE_SQL}),
new_rows AS (
  SELECT * FROM feature_rows WHERE transaction_date BETWEEN DATE '2001-10-01' AND DATE '2001-10-31'
  ORDER BY transaction_date DESC, transaction_id LIMIT 500
),
history_rows AS (
  SELECT * FROM feature_rows WHERE transaction_date >= DATE '1998-10-01' AND transaction_date < DATE '2001-10-01'
  QUALIFY ROW_NUMBER() OVER (PARTITION BY date_trunc('month', transaction_date) ORDER BY md5(transaction_id || '#42'), transaction_id) <= 100
),
combined AS (SELECT *, 'new' AS source FROM new_rows UNION ALL SELECT *, 'historical' FROM history_rows),
holed AS (
  SELECT * REPLACE (CASE WHEN quantity <> 13 THEN quantity END AS quantity, CASE WHEN brand <> 'Brand#5' THEN category END AS category,
                    CASE WHEN month <> 7 THEN month END AS month, CASE WHEN quarter <> 1 THEN is_holiday END AS is_holiday)
  FROM combined
)"""


def _combined(spark, sf_dir) -> DataFrame:
    s = load_star(spark, sf_dir)
    return X.combine(X.current_month(s, AS_OF), X.history_sample(s, AS_OF))


def feat_current_month(spark, sf_dir):
    return shown(X.current_month(load_star(spark, sf_dir), AS_OF))


def feat_history_sample(spark, sf_dir):
    return shown(X.history_sample(load_star(spark, sf_dir), AS_OF))


def feat_demand_columns(spark, sf_dir):
    return shown(X.demand_columns(load_star(spark, sf_dir)))


def feat_combine(spark, sf_dir):
    return shown(_combined(spark, sf_dir), "source")


def feat_decay_weight(spark, sf_dir):
    return training(spark, sf_dir).select("transaction_id", "source", rounded(F.col("sample_weight"), 6).cast("double").alias("sample_weight"))


def feat_impute(spark, sf_dir):
    """Holes are cut first, then filled with median, mode, 0 or 'none'."""
    rows = training(spark, sf_dir)
    holed = spool(rows.withColumns({
        "quantity": F.when(F.col("quantity") != 13, F.col("quantity")),
        "category": F.when(F.col("brand") != "Brand#5", F.col("category")),
        "month": F.when(F.col("month") != 7, F.col("month")),
        "is_holiday": F.when(F.col("quarter") != 1, F.col("is_holiday"))}), "holed")
    fills = X.impute_values(holed, ["quantity"], ["category"])
    return X.impute(holed, fills, ["month"], ["marketing_event"], ["is_holiday"]).select(
        "transaction_id", "quantity", "category", "month", "marketing_event", "is_holiday")


def feat_one_hot(spark, sf_dir):
    return M.one_hot_levels(M.prepared(training(spark, sf_dir), M.DEMAND), M.DEMAND)


def ml_stratified_split(spark, sf_dir):
    return X.stratified_split(training(spark, sf_dir), "net_amount").select("transaction_id", "bin", "split")


# --------------------------------------------------------------------- models

def ml_train_revenue(spark, sf_dir):
    return _model(spark, sf_dir, M.REVENUE)[1]


def ml_train_demand(spark, sf_dir):
    return _model(spark, sf_dir, M.DEMAND)[1]


def ml_evaluate(spark, sf_dir):
    """The list value of a sale as a stand-in prediction of its net amount."""
    sales = load_star(spark, sf_dir).sales
    return M.evaluate(sales, F.col("net_amount"), (F.col("quantity") * F.col("list_price")).cast("decimal(14,2)"))


def ml_importance(spark, sf_dir):
    return M.importances(spark, _model(spark, sf_dir, M.DEMAND)[0], M.DEMAND)


def ml_predict(spark, sf_dir):
    """Every sale of the star scored by the demand model."""
    model, _ = _model(spark, sf_dir, M.DEMAND)
    rows = X.impute(X.demand_columns(load_star(spark, sf_dir)), {}, [], ["marketing_event"], ["is_holiday"])
    rows = rows.withColumns({c: dbl(c) for c in ("unit_price", "list_price")})
    return M.predict(model, rows).select("transaction_id", "quantity", rounded(F.col("predicted_qty"), 4).cast("double").alias("predicted_qty"))


def rep_leakage_opportunity(spark, sf_dir):
    return M.leakage_opportunity(load_star(spark, sf_dir), _model(spark, sf_dir, M.DEMAND)[0], 0.0)


def rep_band_elasticity(spark, sf_dir):
    return M.band_elasticity(load_star(spark, sf_dir), _model(spark, sf_dir, M.DEMAND)[0])


def rep_custom_rate_demand(spark, sf_dir):
    return M.custom_rate_demand(load_star(spark, sf_dir), _model(spark, sf_dir, M.DEMAND)[0], 0.12)


# --------------------------------------------------------------------- series

def ts_aggregate_series(spark, sf_dir):
    return T.aggregate_series(load_star(spark, sf_dir), AS_OF)


def ts_slice_series(spark, sf_dir):
    return T.slice_series(load_star(spark, sf_dir), AS_OF)


def ts_min_obs_gate(spark, sf_dir):
    gate = T.observation_gate(T.slice_series(load_star(spark, sf_dir), AS_OF))
    return gate.select(*T.SLICE, big("n_obs").alias("n_obs"), big("nonzero_months").alias("nonzero_months"), "status")


def ts_seasonal_baseline(spark, sf_dir):
    return T.seasonal_baseline(T.slice_series(load_star(spark, sf_dir), AS_OF))


def ts_order_grid(spark, sf_dir):
    return _fits(spark, sf_dir)[2].select("slice_id", *T.ORDER, rounded(F.col("aic"), 4).cast("double").alias("aic"))


def ts_forecast_ci(spark, sf_dir):
    _, arrays, models = _slices(spark, sf_dir)
    return T.forecast_ci(arrays, models, 10)


def ts_fit_metrics(spark, sf_dir):
    return T.manifest(*_slices(spark, sf_dir))


def rep_forecast(spark, sf_dir):
    with small_tasks(spark):  # the series is written inside
        return T.aggregate_forecast(sales_star(spark, sf_dir), AS_OF, 3)


def rep_revenue_forecast(spark, sf_dir):
    return T.forecast_totals(T.slice_forecast(*_slices(spark, sf_dir), horizon=3))


def dash_forecast_band(spark, sf_dir):
    rows = T.slice_forecast(*_slices(spark, sf_dir), horizon=6, region="asia")
    return T.forecast_totals(rows).withColumn("month_order", F.col("year") * 100 + F.col("month"))


SLICES = f"""slice_months AS (
  SELECT category, region_id, region_name, CAST(date_trunc('month', transaction_date) AS DATE) AS month_start,
         {sql_dbl('SUM(net_amount)')} AS net
  FROM live_sales WHERE transaction_date < DATE '2001-10-01' GROUP BY ALL
),
slice_series AS (
  SELECT s.category, s.region_id, s.region_name, CAST(g.m AS DATE) AS month_start, COALESCE(v.net, 0) AS net_revenue
  FROM (SELECT DISTINCT category, region_id, region_name FROM slice_months) s
  CROSS JOIN generate_series((SELECT MIN(month_start) FROM slice_months), (SELECT MAX(month_start) FROM slice_months), INTERVAL 1 MONTH) AS g(m)
  LEFT JOIN slice_months v ON v.category = s.category AND v.region_id = s.region_id AND v.month_start = g.m
)"""


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["feat_current_month"] = Query(feat_current_month, star("SELECT * FROM new_rows", TRAINING))
    q["feat_history_sample"] = Query(feat_history_sample, star("SELECT * FROM history_rows", TRAINING))
    q["feat_demand_columns"] = Query(feat_demand_columns, star("SELECT * FROM feature_rows", TRAINING))
    q["feat_combine"] = Query(feat_combine, star("SELECT * FROM combined", TRAINING))
    q["feat_decay_weight"] = Query(feat_decay_weight, star("""
      SELECT transaction_id, source, CASE WHEN source = 'new' THEN 1.0::DOUBLE ELSE
        CAST(ROUND(CAST(pow(0.5, ((SELECT MAX(transaction_date) FROM combined) - transaction_date) / 180.0) AS DECIMAL(38,10)), 6) AS DOUBLE) END AS sample_weight
      FROM combined""", TRAINING))
    q["feat_impute"] = Query(feat_impute, star("""
      SELECT transaction_id, CAST(COALESCE(quantity, (SELECT MEDIAN(quantity) FROM holed)) AS DOUBLE) AS quantity,
             COALESCE(category, (SELECT MODE() WITHIN GROUP (ORDER BY category) FROM holed)) AS category,
             COALESCE(month, 0) AS month, COALESCE(marketing_event, 'none') AS marketing_event,
             CAST(COALESCE(is_holiday, FALSE) AS INTEGER) AS is_holiday FROM holed""", TRAINING))
    labels = ("category", "brand", "store_type", "season", "marketing_event")
    q["feat_one_hot"] = Query(feat_one_hot, star(" UNION ALL ".join(f"""
      SELECT '{c}' AS feature, level, CAST(ROW_NUMBER() OVER (ORDER BY level) - 1 AS INTEGER) AS slot, rows
      FROM (SELECT COALESCE({c}, 'none') AS level, {sql_big('COUNT(*)')} AS rows FROM combined GROUP BY 1)""" for c in labels), TRAINING))
    q["ml_stratified_split"] = Query(ml_stratified_split, star("""
      SELECT transaction_id, bin, CASE WHEN place <= floor(size * CAST(0.8 AS DOUBLE) + CAST(1e-9 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY bin ORDER BY md5(transaction_id || '#42'), transaction_id) AS place,
                   COUNT(*) OVER (PARTITION BY bin) AS size
            FROM (SELECT c.*, CAST((SELECT COUNT(*) FROM edges WHERE c.net_amount > e) AS INTEGER) AS bin FROM combined c))""", TRAINING, """edges AS (
        SELECT DISTINCT CAST(CAST(unnest(quantile_cont(net_amount, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS DECIMAL(38,6)) AS DOUBLE) AS e
        FROM combined)"""))
    err = "CAST(net_amount - CAST(quantity * list_price AS DECIMAL(14,2)) AS DECIMAL(15,2))"
    q["ml_evaluate"] = Query(ml_evaluate, star(f"""
      SELECT {sql_big('n')} AS rows, CAST(CAST(sqrt(sse / n) AS DECIMAL(38,4)) AS DOUBLE) AS rmse, CAST(CAST(sae / n AS DECIMAL(38,4)) AS DOUBLE) AS mae,
             CAST(CAST(1 - sse / (syy - sy * sy / n) AS DECIMAL(38,6)) AS DOUBLE) AS r2
      FROM (SELECT COUNT(*) AS n, {sql_dbl(f'SUM({err} * {err})')} AS sse, {sql_dbl(f'SUM(abs({err}))')} AS sae,
                   {sql_dbl('SUM(net_amount)')} AS sy, {sql_dbl('SUM(net_amount * net_amount)')} AS syy
            FROM all_sales)"""))
    for name in ("ml_train_revenue", "ml_train_demand", "ml_importance", "ml_predict", "rep_leakage_opportunity", "rep_band_elasticity",
                 "rep_custom_rate_demand", "ts_order_grid", "ts_forecast_ci", "ts_fit_metrics", "rep_forecast", "rep_revenue_forecast",
                 "dash_forecast_band"):
        q[name] = Query(globals()[name])

    q["ts_aggregate_series"] = Query(ts_aggregate_series, star(f"""
      SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month_start, {sql_dbl('SUM(net_amount)')} AS net_revenue
      FROM sales_transactions WHERE transaction_date < DATE '2001-10-01' GROUP BY 1"""))
    q["ts_slice_series"] = Query(ts_slice_series, star("SELECT * FROM slice_series", SLICES))
    q["ts_min_obs_gate"] = Query(ts_min_obs_gate, star(f"""
      SELECT category, region_id, region_name, {sql_big('COUNT(*)')} AS n_obs, {sql_big('COUNT(*) FILTER (net_revenue <> 0)')} AS nonzero_months,
             CASE WHEN COUNT(*) >= 24 THEN 'trained' ELSE 'skipped' END AS status FROM slice_series GROUP BY ALL""", SLICES))
    two = lambda x: f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 2) AS DOUBLE)"
    q["ts_seasonal_baseline"] = Query(ts_seasonal_baseline, star(f"""
      SELECT b.category, b.region_id, b.region_name, CAST(b.month_start + INTERVAL 12 MONTH AS DATE) AS month_start,
             {two('b.net_revenue + drift')} AS predicted, {two('b.net_revenue + drift - CAST(1.96 AS DOUBLE) * spread')} AS lower,
             {two('b.net_revenue + drift + CAST(1.96 AS DOUBLE) * spread')} AS upper
      FROM slice_series b JOIN (
        SELECT a.category, a.region_id, AVG(a.net_revenue - p.net_revenue) AS drift, STDDEV_SAMP(a.net_revenue - p.net_revenue) AS spread
        FROM slice_series a JOIN slice_series p ON p.category = a.category AND p.region_id = a.region_id
          AND p.month_start = a.month_start - INTERVAL 12 MONTH GROUP BY ALL) s
        ON s.category = b.category AND s.region_id = b.region_id
      WHERE b.month_start > (SELECT MAX(month_start) FROM slice_series) - INTERVAL 12 MONTH""", SLICES))
    return q
