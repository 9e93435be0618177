"""Queries: model data sets, folds, metrics, fits, scoring (M, I, S, A11-A12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sql as o
from catalog.registry import hourly, query, r6, readings, scored
from ohmwatch.functions import diagnostics as d
from ohmwatch.functions.guards import add
from ohmwatch.learning import datasets as ds
from ohmwatch.learning import evaluation as ev
from ohmwatch.learning import models as m
from ohmwatch.operators.sequences import failure_label, lags_and_future
from ohmwatch.plans import incremental, scoring, training
from ohmwatch.plans.features import build_features, feature_columns
from ohmwatch.plans.prepare import prepare
from ohmwatch.session import run_dir, shuffles_freed
from ohmwatch.sources import fixtures, store
from ohmwatch.sources import readings as src

KEYS = ["asset_id", "ts"]
COLS = o.COLS
OTHERS = [c for c in COLS if c != "top_oil_temp"]
HORIZON, N_LAGS = 24, 24
LAGS = [f"top_oil_temp_lag{k}" for k in range(1, N_LAGS + 1)]
SHIFTED = ", ".join(f"lag(top_oil_temp, {k}) OVER ({o.PER_ASSET}) AS top_oil_temp_lag{k}" for k in range(1, N_LAGS + 1))
FUTURE = f"lead(top_oil_temp, {HORIZON}) OVER ({o.PER_ASSET}) AS future_target"
SUPERVISED = (
    f"{o.HOURLY}, shifted AS (SELECT *, {SHIFTED}, {FUTURE} FROM hourly), supervised AS (SELECT * FROM shifted "
    f"WHERE top_oil_temp_lag{N_LAGS} IS NOT NULL AND future_target IS NOT NULL)"
)


def _dataset(spark, sf):
    return ds.forecast_dataset(hourly(spark, sf), "top_oil_temp", HORIZON, COLS, N_LAGS)


@query(
    "m1_forecast_dataset",
    f"WITH {SUPERVISED} SELECT asset_id, ts, {o.rounded([*OTHERS, *LAGS, 'future_target'])} FROM supervised",
)
def _(spark, sf):
    return r6(_dataset(spark, sf))


def _labelled(spark, sf):
    rated = add(hourly(spark, sf), {"health_index": d.health_index()})
    return failure_label(rated, o.LABEL_WINDOW, o.LABEL_LEVEL)


@query(
    "m2_classification_dataset",
    f"WITH {o.HOURLY}, {o.LABEL} SELECT asset_id, ts, {o.rounded(COLS)}, failure_label FROM labelled",
)
def _(spark, sf):
    return r6(ds.classification_dataset(_labelled(spark, sf), COLS))


@query(
    "m3_standardise",
    f"WITH {o.HOURLY} SELECT asset_id, ts, "
    + ", ".join(
        o.r6(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)", c) for c in COLS
    )
    + " FROM hourly",
)
def _(spark, sf):
    series = hourly(spark, sf).select(*KEYS, *COLS)
    return r6(ds.standardise(series, ds.scaling_facts(series, COLS)))


@query(
    "m4_minimum_rows",
    f"WITH {SUPERVISED} SELECT asset_id, count(*) AS n_rows, sum(count(*)) OVER () >= 50 AS enough "
    "FROM supervised GROUP BY 1",
)
def _(spark, sf):
    data = _dataset(spark, sf)
    return data.groupBy("asset_id").agg(
        F.count("*").alias("n_rows"), F.lit(ds.enough_rows(data)).alias("enough")
    )


@query(
    "m6_time_folds",
    f"WITH {SUPERVISED}, numbered AS (SELECT asset_id, ts, row_number() OVER ({o.PER_ASSET}) AS rn, "
    "count(*) OVER (PARTITION BY asset_id) AS n FROM supervised) "
    "SELECT asset_id, ts, CAST(CASE WHEN rn <= n - 5 * (n // 6) THEN 0 "
    "ELSE (rn - 1 - (n - 5 * (n // 6))) // (n // 6) + 1 END AS INTEGER) AS fold, rn AS row_no FROM numbered",
)
def _(spark, sf):
    return ds.fold_numbers(_dataset(spark, sf)).select(*KEYS, "fold", "row_no")


FORECASTED = f"""{o.HOURLY}, forecasted AS (SELECT * FROM (SELECT asset_id, top_oil_temp AS y_true,
      lag(top_oil_temp, 24) OVER ({o.PER_ASSET}) AS y_pred FROM hourly)
    WHERE y_pred IS NOT NULL AND y_true IS NOT NULL)"""


@query(
    "m11_regression_errors",
    f"WITH {FORECASTED} SELECT asset_id, {o.r6('sqrt(avg(pow(y_true - y_pred, 2)))', 'rmse')}, "
    f"{o.r6('avg(abs(y_true - y_pred))', 'mae')}, count(*) AS n FROM forecasted GROUP BY 1",
)
def _(spark, sf):
    return r6(ev.regression_errors(_forecasted(spark, sf), ("asset_id",)))


def _forecasted(spark, sf):
    moved = lags_and_future(hourly(spark, sf).select(*KEYS, "top_oil_temp"), "top_oil_temp", 24)
    pairs = moved.selectExpr("asset_id", "top_oil_temp AS y_true", "top_oil_temp_lag24 AS y_pred")
    return pairs.dropna()


@query(
    "m11_errors_over_groups",
    f"WITH {FORECASTED}, per AS (SELECT asset_id, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, "
    "avg(abs(y_true - y_pred)) AS mae FROM forecasted GROUP BY 1) "
    f"SELECT {o.r6('avg(rmse)', 'cv_rmse_mean')}, {o.r6('stddev_pop(rmse)', 'cv_rmse_std')}, {o.r6('avg(mae)', 'cv_mae_mean')} FROM per",
)
def _(spark, sf):
    return r6(ev.over_folds(ev.regression_errors(_forecasted(spark, sf), ("asset_id",))))


def _auc_sql(group: str) -> str:
    part = f"PARTITION BY {group} " if group else ""
    keys = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""ranked AS (SELECT *, rank() OVER ({part}ORDER BY failure_proba) + (count(*) OVER (PARTITION BY {keys}failure_proba) - 1) / 2E0 AS rk FROM scored)
    SELECT {keys}round(2E0 * count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) / (2 * count(*) FILTER (WHERE y_true = 1 AND y_pred = 1)
        + count(*) FILTER (WHERE y_true <> y_pred)) + 13E-9, 6) AS f1,
      round((sum(rk) FILTER (WHERE y_true = 1) - count(*) FILTER (WHERE y_true = 1) * (count(*) FILTER (WHERE y_true = 1) + 1) / 2E0)
        / (1E0 * count(*) FILTER (WHERE y_true = 1) * count(*) FILTER (WHERE y_true = 0)) + 13E-9, 6) AS auc
    FROM ranked {by}"""


@query("m12_f1_and_auc", f"WITH {o.SCORED}, {_auc_sql('')}")
def _(spark, sf):
    return r6(ev.f1_and_auc(scored(spark, sf)))


@query("m12_f1_and_auc_by_asset", f"WITH {o.SCORED}, {_auc_sql('asset_id')}")
def _(spark, sf):
    return r6(ev.f1_and_auc(scored(spark, sf), ("asset_id",)))


CELLS = (
    "SELECT count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp, "
    "count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn FROM scored"
)


REPORT = f"""WITH {o.SCORED}, cells AS ({CELLS}), k AS (
      SELECT '0' AS class, 1E0 * tn / (tn + fn) AS precision, 1E0 * tn / (tn + fp) AS recall, tn + fp AS support FROM cells
      UNION ALL SELECT '1', 1E0 * tp / (tp + fp), 1E0 * tp / (tp + fn), tp + fn FROM cells),
    s AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM k),
    rows AS (SELECT class, precision, recall, f1, support FROM s
      UNION ALL SELECT 'accuracy', 1E0 * (tp + tn) / (tp + tn + fp + fn), 1E0 * (tp + tn) / (tp + tn + fp + fn),
        1E0 * (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM cells
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM s
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM s)
    SELECT class, {o.r6('precision', 'precision')}, {o.r6('recall', 'recall')}, {o.r6('f1', 'f1')}, support FROM rows"""


@query("m13_classification_report", REPORT)
def _(spark, sf):
    return r6(ev.classification_report(scored(spark, sf)))


@query("a12_report_table", f"{REPORT} WHERE class <> 'accuracy'")
def _(spark, sf):
    return r6(ev.report_table(ev.classification_report(scored(spark, sf))))


@query(
    "m14_confusion_matrix",
    f"WITH {o.SCORED}, cells AS ({CELLS}) SELECT 0 AS actual, 0 AS predicted, tn AS n FROM cells UNION ALL "
    "SELECT 0, 1, fp FROM cells UNION ALL SELECT 1, 0, fn FROM cells UNION ALL SELECT 1, 1, tp FROM cells",
)
def _(spark, sf):
    return ev.confusion_matrix(scored(spark, sf))


# -- fits over the whole tables; published targets, horizons and folds, fewer trees ------

LABEL_ARGS = (6, 15.0)
SMALL = m.TrainingSettings(n_splits=2).smaller(2, 2, targets=("top_oil_temp",), horizons={"1d": HORIZON})
#: Trees of published depth; the published counts are 300 and 400 (README has their times).
TREES = 3
WEEK = 168


def _stored_label_set(spark, sf):
    """Ten sensors and a balanced label, written once: every fit reads it again."""
    rated = add(hourly(spark, sf), {"health_index": d.health_index()})
    marked = failure_label(rated, *LABEL_ARGS)
    path = run_dir(spark, "labelled")
    ds.classification_dataset(marked, COLS).write.parquet(path)
    return spark.read.parquet(path)


def _failure_model(spark, sf, name="xgb"):
    data = _stored_label_set(spark, sf)
    return m.fit(data, COLS, ds.LABEL, SMALL.classifiers[name]), data


def _written(df, spark, label):
    path = run_dir(spark, label)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


def _features(spark, sf):
    """The feature table of the labelled series, kept by two appends: all but the last day, then that."""
    rated = add(hourly(spark, sf), {"health_index": d.health_index()})
    series = _written(failure_label(rated, *LABEL_ARGS), spark, "series")
    folder = run_dir(spark, "store")
    last = series.agg(F.date_trunc("day", F.max("ts")).alias("t")).first().t
    incremental.append(spark, folder, series.filter(F.col("ts") < F.lit(last)))
    incremental.append(spark, folder, series.filter(F.col("ts") >= F.lit(last)))
    return incremental.read_features(spark, folder)


def _feature_model(features, learner=None):
    """The served classifier on all engineered columns."""
    columns = feature_columns(features)
    return m.fit(ds.classification_dataset(features, columns), columns, ds.LABEL, learner or SMALL.classifiers[m.SERVED])


def _long_features(spark, sf):
    series = prepare(fixtures.long_readings(spark, sf))
    return _written(build_features(series, fill=False), spark, "features")


def _classifier_query(key: str, name: str):
    @query(key)
    def _(spark, sf):
        data = ds.fold_numbers(_stored_label_set(spark, sf), SMALL.n_splits)
        model = m.fit(ds.train_rows(data, SMALL.n_splits), COLS, ds.LABEL, SMALL.classifiers[name])
        tested = m._tested(model, data.filter(f"fold = {SMALL.n_splits}"))
        return ev.f1_and_auc(tested)


_classifier_query("m8_random_forest", "rf")
_classifier_query("m9_gradient_boosting", "gb")


@query("m10_boosted_served")
def _(spark, sf):
    """The served classifier on the feature table: published depth and folds, F1 and AUC by fold."""
    features = _features(spark, sf)
    served = m.CLASSIFIERS[m.SERVED].sized(TREES)
    settings = m.TrainingSettings(classifiers={m.SERVED: served})
    return m.train_classifiers(features, feature_columns(features), settings).metrics


def _forecast_model(features, target="top_oil_temp", horizon=WEEK):
    columns = feature_columns(features)
    data = _written(ds.forecast_dataset(features, target, horizon, columns, N_LAGS), features.sparkSession, "supervised")
    return m.fit(data, ds.forecast_inputs(columns, target, N_LAGS), ds.FUTURE, SMALL.forecaster), data


def _grid(spark, sf, trees, depth, targets=m.FORECAST_TARGETS):
    features = _long_features(spark, sf)
    settings = m.TrainingSettings(forecaster=m.FORECASTER.sized(trees, depth), targets=targets)
    return m.train_forecasts(features, feature_columns(features), settings)[1]


@query("m5_target_horizon_grid")
def _(spark, sf):
    """All targets and horizons with five folds each, grown together."""
    return _grid(spark, sf, TREES, 4)


@query("m7_boosted_forecast")
def _(spark, sf):
    """One target, both horizons, published depth, tested on the rows after those it has learned from."""
    return _grid(spark, sf, TREES, m.FORECASTER.depth, ("top_oil_temp",))


FIRST = 180  # rows until the longest window has a quarter of its values


@query(
    "m5_grid_rows",
    f"""WITH long AS (SELECT event_id % 2 AS asset_id, count(*) AS n FROM events GROUP BY 1),
      targets AS (SELECT unnest([{', '.join(f"'{t}'" for t in m.FORECAST_TARGETS)}]) AS target),
      horizons AS (SELECT * FROM (VALUES ('7d', 168), ('30d', 720)) h(horizon, rows)),
      counted AS (SELECT target, horizon, CAST(sum(greatest(n - {FIRST - 1} - rows, 0)) AS BIGINT) AS n_samples FROM long, targets, horizons GROUP BY 1, 2)
    SELECT target, horizon, n_samples, true AS finite FROM counted WHERE n_samples >= 50""",
)
def _(spark, sf):
    """The grid's rows and what each model has learned from; its errors are finite and positive."""
    metrics = _grid(spark, sf, 1, 1)
    return metrics.select("target", "horizon", "n_samples", F.expr("cv_rmse_mean > 0 AND cv_rmse_std >= 0 AND cv_mae_mean <= cv_rmse_mean").alias("finite"))


@query("m15_training_job")
def _(spark, sf):
    """The whole job at a small size: one target and horizon, short windows, three classifiers."""
    settings = m.TrainingSettings(n_splits=2).smaller(1, 1, targets=("H2",), horizons={"1d": HORIZON})
    tables = training.run_training(
        readings(spark, sf), run_dir(spark, "models"), settings, *LABEL_ARGS, windows=(24,), periods=(1, 24)
    )
    return tables["classifier_metrics"]


@query("i1_health_scores")
def _(spark, sf):
    features = _features(spark, sf)
    return scoring.score_health(features, _feature_model(features)).select(*src.PREDICTION_COLUMNS)


@query("i5_forecast_scores")
def _(spark, sf):
    features = _features(spark, sf)
    model, _ = _forecast_model(features)
    return scoring.score_forecast(features, model, "top_oil_temp", WEEK, N_LAGS)


@query("p12_measured_and_forecast")
def _(spark, sf):
    features = _features(spark, sf)
    model, _ = _forecast_model(features)
    ahead = scoring.score_forecast(features, model, "top_oil_temp", WEEK, N_LAGS)
    return scoring.parameter_view(features, ahead, "top_oil_temp", 100.0)


#: What holds of every scored row whatever the model has learned.
SCORE_RULES = (
    "failure_proba BETWEEN 0 AND 1 AS in_range",
    "abs(health_score - 100 * (1 - failure_proba)) < 1e-9 AS score_fits",
    "risk_level = CASE WHEN health_score <= 40 THEN 'CRITIQUE' WHEN health_score <= 65 THEN 'ALERTE' ELSE 'NORMAL' END AS risk_fits",
)
RULES_HOLD = "true AS in_range, true AS score_fits, true AS risk_fits"
NUMBERED = f"{o.HOURLY}, numbered AS (SELECT asset_id, ts, top_oil_temp, row_number() OVER ({o.PER_ASSET}) AS rn FROM hourly)"


@query("i1_score_rules", f"WITH {o.HOURLY} SELECT asset_id, ts, {RULES_HOLD} FROM hourly")
def _(spark, sf):
    features = _features(spark, sf)
    return scoring.score_health(features, _feature_model(features)).selectExpr(*KEYS, *SCORE_RULES)


@query(
    "i5_forecast_rows",
    f"WITH {NUMBERED} SELECT asset_id, ts, ts + INTERVAL {WEEK} HOUR AS target_ts, 'top_oil_temp' AS target, rn >= {FIRST} AS known FROM numbered",
)
def _(spark, sf):
    features = _features(spark, sf)
    ahead = scoring.score_forecast(features, _forecast_model(features)[0], "top_oil_temp", WEEK, N_LAGS)
    return ahead.select(*KEYS, "target_ts", "target", F.col("forecast").isNotNull().alias("known"))


@query(
    "p12_view_rows",
    f"""WITH {NUMBERED}, ahead AS (SELECT asset_id, ts + INTERVAL {WEEK} HOUR AS ts, rn >= {FIRST} AS known FROM numbered)
    SELECT asset_id, ts, {o.r6('top_oil_temp', 'measured')}, 1E2 AS threshold, coalesce(known, false) AS has_forecast
    FROM numbered FULL JOIN ahead USING (asset_id, ts)""",
)
def _(spark, sf):
    features = _features(spark, sf)
    ahead = scoring.score_forecast(features, _forecast_model(features)[0], "top_oil_temp", WEEK, N_LAGS)
    view = scoring.parameter_view(features, ahead, "top_oil_temp", 100.0)
    return r6(view.select(*KEYS, "measured", "threshold", F.col("forecast").isNotNull().alias("has_forecast")))


def _csv_folder(spark, sf):
    """One folder of CSV files per asset, the asset's number only in the path."""
    path = run_dir(spark, "csv")
    named = readings(spark, sf).withColumnRenamed("asset_id", "unit").drop("reading_id")
    named.write.partitionBy("unit").options(**src.CSV_OPTIONS).csv(path)
    return f"{path}/unit=*/*.csv", r"/unit=(\d+)/"


def _scored_file(spark, sf):
    model, _ = _failure_model(spark, sf)
    path, unit = _csv_folder(spark, sf)
    return scoring.score_file(spark, path, model, asset_from=unit)


@query("i6_score_file")
def _(spark, sf):
    return _scored_file(spark, sf)["kpis"]


@query("i6_scored_rows", f"WITH {o.HOURLY} SELECT asset_id, ts, {RULES_HOLD} FROM hourly")
def _(spark, sf):
    return _scored_file(spark, sf)["predictions"].selectExpr(*KEYS, *SCORE_RULES)


# -- sources and sinks ------------------------------------------------------------

CELLS = f"asset_id, ts, {o.rounded(o.COLS)}, fault_type"


@query("s1_csv_scan", f"WITH {o.READINGS} SELECT {CELLS} FROM readings")
def _(spark, sf):
    path, unit = _csv_folder(spark, sf)
    back = src.read_csv(spark, path, asset_from=unit)
    return r6(back.select("asset_id", "ts", *o.COLS, "fault_type"))


@query("s2_time_detection", f"WITH {o.READINGS} SELECT reading_id, {CELLS} FROM readings")
def _(spark, sf):
    renamed = readings(spark, sf).withColumn("DateTime", F.col("ts").cast("string")).drop("ts")
    found = src.with_time_axis(renamed)
    return r6(found.select("reading_id", "asset_id", "ts", *o.COLS, "fault_type"))


@query("s3_readings_sink", f"WITH {o.READINGS} SELECT reading_id, {CELLS} FROM readings")
def _(spark, sf):
    path = run_dir(spark, "readings")
    src.write_parquet(readings(spark, sf), path)
    return r6(src.read_parquet(spark, path).select("reading_id", "asset_id", "ts", *o.COLS, "fault_type"))


@query(
    "s4_predictions_sink",
    f"WITH {o.SCORED} SELECT asset_id, ts, {o.r6('health_score', 'health_score')}, "
    f"{o.r6('failure_proba', 'failure_proba')}, {o.RISK} AS risk_level FROM scored",
)
def _(spark, sf):
    path = run_dir(spark, "predictions")
    src.write_predictions(scoring.with_health(fixtures.scored(readings(spark, sf))), path)
    return r6(spark.read.csv(path, header=True, inferSchema=True))


STORED = (
    f"WITH {FORECASTED}, per AS (SELECT asset_id, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, "
    "avg(abs(y_true - y_pred)) AS mae FROM forecasted GROUP BY 1) "
    f"SELECT {o.r6('avg(rmse)', 'cv_rmse_mean')}, {o.r6('stddev_pop(rmse)', 'cv_rmse_std')}, "
    f"{o.r6('avg(mae)', 'cv_mae_mean')}, 'top_oil_temp' AS target, '1d' AS horizon, 0::BIGINT AS n_samples FROM per"
)


def _written_metrics(spark, sf):
    folder = run_dir(spark, "metrics")
    errors = ev.regression_errors(_forecasted(spark, sf), ("asset_id",))
    table = ev.over_folds(errors).selectExpr("'top_oil_temp' AS target", "'1d' AS horizon", "*", "0 AS n_samples")
    store.save_metrics(table, folder, "forecast_metrics")
    return folder


@query("s5_metrics_sink", STORED)
def _(spark, sf):
    return r6(spark.read.json(f"{_written_metrics(spark, sf)}/forecast_metrics"))


@query("s6_metrics_scan", STORED)
def _(spark, sf):
    return r6(store.load_metrics(spark, _written_metrics(spark, sf))["forecast_metrics"])


FIGURES = ", ".join(
    f"{o.even(x, 3)} AS {n}"
    for n, x in {"cv_rmse_mean": "avg(rmse)", "cv_rmse_std": "stddev_pop(rmse)", "cv_mae_mean": "avg(mae)"}.items()
)


@query(
    "a11_forecast_table",
    f"WITH {FORECASTED}, per AS (SELECT asset_id, count(*) AS n, sqrt(avg(pow(y_true - y_pred, 2))) AS rmse, "
    "avg(abs(y_true - y_pred)) AS mae FROM forecasted GROUP BY 1) "
    f"SELECT 'top_oil_temp' AS target, '1d' AS horizon, 'nested' AS shape, {FIGURES}, sum(n)::BIGINT AS n_samples FROM per "
    f"UNION ALL SELECT 'top_oil_temp', '1d', 'long', {FIGURES}, 0 FROM per",
)
def _(spark, sf):
    flat = store.forecast_table(spark.read.json(f"{_written_metrics(spark, sf)}/forecast_metrics"))
    figures = ev.regression_errors(_forecasted(spark, sf), ("asset_id",)).groupBy().agg(
        F.to_json(
            F.struct(
                F.struct(
                    F.struct(
                        F.avg("rmse").alias("cv_rmse_mean"),
                        F.stddev_pop("rmse").alias("cv_rmse_std"),
                        F.avg("mae").alias("cv_mae_mean"),
                        F.sum("n").alias("n_samples"),
                    ).alias("1d")
                ).alias("top_oil_temp")
            )
        ).alias("value")
    )
    path = run_dir(spark, "nested")
    figures.coalesce(1).write.text(path)
    nested = store.forecast_table(store.nested_forecast_metrics(spark, path))
    return nested.withColumn("shape", F.lit("nested")).unionByName(flat.withColumn("shape", F.lit("long")))


def _saved(spark, sf):
    model, data = _failure_model(spark, sf)
    folder = run_dir(spark, "models")
    store.save_model(model, folder, store.SERVED_MODEL)
    return folder, data


def _same(one, two, *values):
    """Rows of both, and whether their values agree."""
    other = two.select(*KEYS, *[F.col(v).alias(f"other_{v}") for v in values])
    alike = " AND ".join(f"`{v}` <=> other_{v}" for v in values)
    return one.join(other, KEYS, "full").select(*KEYS, F.expr(alike).alias("same"))


SAME = f"WITH {o.HOURLY} SELECT asset_id, ts, true AS same FROM hourly"


@query("s7_save_models", SAME)
def _(spark, sf):
    """A model that was saved and read back scores every row as the one in memory."""
    model, data = _failure_model(spark, sf)
    folder = run_dir(spark, "models")
    store.save_model(model, folder, store.SERVED_MODEL)
    back = store.load_model(spark, folder, store.SERVED_MODEL)
    before, after = (m.probability(x, data, m.model_inputs(x)) for x in (model, back))
    return _same(before, after, "failure_proba")


@query("s8_load_models", SAME)
def _(spark, sf):
    """The served classifier and a forecast beside it: both are found, and score as those in memory."""
    model, data = _failure_model(spark, sf)
    ahead = m.fit(data.withColumn(ds.FUTURE, F.col("H2")), COLS, ds.FUTURE, SMALL.forecaster)
    folder = run_dir(spark, "models")
    store.save_model(model, folder, store.SERVED_MODEL)
    store.save_model(ahead, folder, store.forecast_name("H2", "7d"))
    found = store.load_models(spark, folder)
    before, after = (
        x.transform(scoring.score_health(data, y)) for x, y in ((ahead, model), (found["forecast_H2_7d"], found[store.SERVED_MODEL]))
    )
    return _same(before, after, "failure_proba", "health_score", "risk_level", "prediction")
