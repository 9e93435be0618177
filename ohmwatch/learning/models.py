"""Forecast and failure models with time-ordered cross-validation.

Forecasts and the served classifier are second-order boosted trees (``newton``): all targets, horizons and folds of a
table grow in step.  The forest and the first-order boosting beside it are Spark ML's.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmwatch.config import FORECAST_HORIZONS, FORECAST_TARGETS, KEY, N_LAGS, N_SPLITS, TIME
from ohmwatch.learning.datasets import (
    LABEL,
    classification_dataset,
    fold_numbers,
    fold_plan,
    forecast_grid,
    grid_folds,
    lag_columns,
    train_rows,
)
from ohmwatch.learning.evaluation import (
    confusion_counts,
    f1_and_auc,
    matrix_from_counts,
    over_folds,
    regression_errors,
    report_from_counts,
)
from ohmwatch.learning.newton import BINS, Booster, Ensemble, Spec, binned, quantile_cuts
from ohmwatch.learning.newton import fit as fit_newton
from ohmwatch.session import run_dir, shuffles_freed

SEED = 42


@dataclass(frozen=True)
class Learner:
    """Size of a tree ensemble, for the folds and for the final fit."""

    kind: str
    depth: int
    fold_trees: int
    trees: int
    rate: float = 0.05
    row_share: float = 1.0
    column_share: float = 1.0
    bins: int = BINS

    def sized(self, trees: int, depth: int | None = None) -> Learner:
        return replace(self, fold_trees=trees, trees=trees, depth=depth or self.depth)

    @property
    def newton(self) -> bool:
        return self.kind in ("squared", "logistic")

    def spec(self, name: str, label: str, inputs, final: bool = True, **rows) -> Spec:
        trees = self.trees if final else self.fold_trees
        return Spec(
            name, label, tuple(inputs), self.kind, trees, self.depth, self.rate, self.row_share, self.column_share, seed=SEED, **rows
        )

    def estimator(self, label: str, final: bool):
        trees = self.trees if final else self.fold_trees
        common = dict(labelCol=label, featuresCol="features", maxDepth=self.depth, seed=SEED)
        if self.kind == "forest":
            return RandomForestClassifier(numTrees=trees, **common)
        return GBTClassifier(maxIter=trees, stepSize=self.rate, **common)


# Ensemble sizes of the published training run.
FORECASTER = Learner("squared", 6, 300, 400, row_share=0.8, column_share=0.8)
CLASSIFIERS = {
    "rf": Learner("forest", 10, 200, 300),
    "gb": Learner("classifier", 5, 200, 300),
    "xgb": Learner("logistic", 6, 300, 400),
}
# The final forest is grown deeper than the ones in the folds.
FINAL_DEPTH = {"rf": 12}
SERVED = "xgb"


@dataclass
class TrainingSettings:
    forecaster: Learner = FORECASTER
    classifiers: dict[str, Learner] = field(default_factory=lambda: dict(CLASSIFIERS))
    final_depth: dict[str, int] = field(default_factory=lambda: dict(FINAL_DEPTH))
    targets: tuple[str, ...] = FORECAST_TARGETS
    horizons: dict[str, int] = field(default_factory=lambda: dict(FORECAST_HORIZONS))
    n_splits: int = N_SPLITS
    n_lags: int = N_LAGS
    gap: int = 0
    parallel_fits: int = 3

    def smaller(self, trees: int, depth: int | None = None, **changes) -> TrainingSettings:
        return replace(
            self,
            forecaster=self.forecaster.sized(trees, depth),
            classifiers={n: c.sized(trees, depth) for n, c in self.classifiers.items()},
            final_depth={},
            **changes,
        )


def fit(df: DataFrame, inputs: list[str], label: str, learner: Learner, final: bool = True) -> PipelineModel | Ensemble:
    """One model.  Spark ML's are a pipeline with a scaler that sees training rows only; trees on
    bins need no scaling."""
    if learner.newton:
        return fit_newton(df, learner.spec(label, label, inputs, final), learner.bins)
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="raw", handleInvalid="error"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        learner.estimator(label, final),
    ]
    return Pipeline(stages=stages).fit(df)


def _positive() -> Column:
    """Probability of class 1; 0 of a forest that has seen class 0 only, whose vectors have one cell."""
    return F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))


def probability(model: PipelineModel | Ensemble, df: DataFrame, inputs: list[str]) -> DataFrame:
    """Probability of failure per row; absent or missing inputs count as zero."""
    absent = [c for c in inputs if c not in df.columns]
    ready = df.selectExpr(
        *[f"coalesce(`{c}`, 0) AS `{c}`" if c in inputs else f"`{c}`" for c in df.columns],
        *[f"0D AS `{c}`" for c in absent],
    )
    if isinstance(model, Ensemble):
        return model.transform(ready, "failure_proba")
    scored = model.transform(ready)
    return scored.withColumn("failure_proba", _positive())


def model_inputs(model: PipelineModel | Ensemble) -> list[str]:
    return list(model.inputs) if isinstance(model, Ensemble) else model.stages[0].getInputCols()


def _stored(df: DataFrame) -> DataFrame:
    """Written once to the shared folder: every fit scans it, no executor holds it."""
    path = run_dir(df.sparkSession, "fit")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _all(jobs, parallel: int) -> list:
    """Run independent fits side by side; each is a Spark job of its own."""
    if parallel <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(parallel) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def _small(parts: list[DataFrame]) -> DataFrame:
    """A handful of one-row results, written once so later reads cost no refit."""
    spark = parts[0].sparkSession
    path = run_dir(spark, "metrics")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def train_forecasts(
    features: DataFrame, columns: list[str], settings: TrainingSettings
) -> tuple[dict[tuple[str, str], Ensemble], DataFrame | None]:
    """One model per target and horizon, with its cross-validation figures.

    All of them, and those of their folds, read one table and grow together.  A target that is absent, and a pair
    with fewer than ten rows per split, is skipped.
    """
    targets = [t for t in settings.targets if t in features.columns]
    if not targets or not settings.horizons:
        return {}, None
    with shuffles_freed(features.sparkSession):
        return _train_forecasts(features, columns, settings, targets)


def _train_forecasts(features: DataFrame, columns: list[str], settings: TrainingSettings, targets: list[str]):
    present = [c for c in columns if c in features.columns]
    grid, inputs = forecast_grid(features, targets, settings.horizons, present, settings.n_lags)
    grid = _stored(grid)
    labels = {(t, h): f"{t}_in_{h}" for t in targets for h in settings.horizons}
    counts = grid.agg(*[F.count(c).alias(c) for c in labels.values()]).first()
    wanted = {pair: c for pair, c in labels.items() if counts[c] >= 10 * settings.n_splits}
    if not wanted:
        return {}, None
    # A horizon's rows are those with any known future: the folds of all its targets.
    cuts = quantile_cuts(grid, inputs, settings.forecaster.bins)
    for h in {h for _, h in wanted}:
        if all((t, h) in wanted for t in targets):
            grid = grid_folds(grid, targets, h, settings.n_splits, settings.gap)
            continue
        # Futures of a target that is left out (a few rows) do not count.
        known = grid.filter(" OR ".join(f"`{c}` IS NOT NULL" for (_, own), c in wanted.items() if own == h))
        plan = fold_plan(known, settings.n_splits, settings.gap)
        grid = grid.join(plan.toDF(KEY, TIME, f"fold_{h}", f"learns_{h}"), [KEY, TIME], "left")
    learner, specs, tests = settings.forecaster, [], {}
    for (t, h), label in wanted.items():
        own = [*[c for c in present if c != t], *lag_columns(t, settings.n_lags)]
        specs.append(learner.spec(f"{label}|0", label, own))
        for k in range(1, settings.n_splits + 1):
            specs.append(learner.spec(f"{label}|{k}", label, own, final=False, fold=f"learns_{h}", below=k + 1))
            tests[f"{label}|{k}"] = (f"fold_{h}", k)
    keep = [*wanted.values(), *[f"{x}_{h}" for h in {h for _, h in wanted} for x in ("fold", "learns")]]
    booster = Booster(binned(grid, inputs, keep, cuts), inputs, cuts, specs, learner.bins)
    booster.grow()
    made = {s.name: m for s, m in zip(specs, booster.models)}
    errors = _small([regression_errors(booster.predictions(tests), ("model",), "y_true", "prediction")])
    spark = features.sparkSession
    names = spark.createDataFrame([(c, t, h, int(counts[c])) for (t, h), c in wanted.items()], "label string, target string, horizon string, n_samples long")
    per_fold = errors.withColumn("label", F.substring_index("model", "|", 1)).join(F.broadcast(names), "label")
    metrics = over_folds(per_fold, ("target", "horizon", "n_samples"))
    order = ["target", "horizon", "cv_rmse_mean", "cv_rmse_std", "cv_mae_mean", "n_samples"]
    return {pair: made[f"{c}|0"] for pair, c in wanted.items()}, metrics.select(*order)


@dataclass
class ClassifierResult:
    models: dict[str, PipelineModel | Ensemble]
    inputs: list[str]
    metrics: DataFrame
    report: DataFrame
    matrix: DataFrame


def _tested(model: PipelineModel | Ensemble, df: DataFrame) -> DataFrame:
    if isinstance(model, Ensemble):
        scored = model.transform(df, "failure_proba")
        return scored.selectExpr(f"{LABEL} AS y_true", "CAST(failure_proba > 0.5D AS INT) AS y_pred", "failure_proba")
    scored = model.transform(df).withColumn("failure_proba", _positive())
    return scored.selectExpr(f"{LABEL} AS y_true", "CAST(prediction AS INT) AS y_pred", "failure_proba")


def _boosted_classifier(folded: DataFrame, inputs: list[str], learner: Learner, settings: TrainingSettings):
    """The final model and (fold, tested rows) of the folds with both classes, all grown together."""
    plan = fold_plan(folded, settings.n_splits, settings.gap).select(KEY, TIME, "learns")
    rows = folded.join(plan, [KEY, TIME])
    seen = rows.groupBy("learns").agg(F.min(LABEL).alias("lo"), F.max(LABEL).alias("hi")).collect()
    both = [k for k in range(1, settings.n_splits + 1) if len({x for r in seen if r.learns <= k for x in (r.lo, r.hi)}) == 2]
    specs = [learner.spec("0", LABEL, inputs), *[learner.spec(str(k), LABEL, inputs, False, fold="learns", below=k + 1) for k in both]]
    cuts = quantile_cuts(folded, inputs, learner.bins)
    booster = Booster(binned(rows, inputs, [LABEL, "fold", "learns"], cuts), inputs, cuts, specs, learner.bins)
    final = booster.grow()[0]
    scored = _small([booster.predictions({str(k): ("fold", k) for k in both})])
    shown = scored.selectExpr("model", "CAST(y_true AS INT) AS y_true", "CAST(prediction > 0.5D AS INT) AS y_pred", "prediction AS failure_proba")
    return final, [(k, shown.filter(F.col("model") == str(k)).drop("model")) for k in both]


def train_classifiers(
    features: DataFrame, columns: list[str], settings: TrainingSettings
) -> ClassifierResult:
    """Fit every classifier; F1 and AUC by fold; report of the served one's last fold."""
    if LABEL not in features.columns:
        raise ValueError(f"label column '{LABEL}' is missing")
    data = classification_dataset(features, columns)
    inputs = [c for c in data.columns if c not in (LABEL, KEY, TIME)]
    folded = _stored(fold_numbers(data, settings.n_splits))

    def one(name: str, k: int):
        learner = settings.classifiers[name]
        train = train_rows(folded, k, settings.gap)
        if train.select(LABEL).distinct().count() < 2:
            return None
        model = fit(train, inputs, LABEL, learner, final=False)
        tested = _tested(model, folded.filter(f"fold = {k}"))
        return name, k, tested

    newton = {n: x for n, x in settings.classifiers.items() if x.newton}
    jobs = [
        lambda n=n, k=k: one(n, k)
        for n in settings.classifiers
        if n not in newton
        for k in range(1, settings.n_splits + 1)
    ]
    tested = [r for r in _all(jobs, settings.parallel_fits) if r is not None]
    models = {}
    for name, learner in newton.items():
        model, folds = _boosted_classifier(folded, inputs, learner, settings)
        models[name] = model
        tested += [(name, k, t) for k, t in folds]
    scores = [
        f1_and_auc(t).select(F.lit(n).alias("model"), F.lit(k).alias("fold"), "f1", "auc")
        for n, k, t in tested
    ]
    spark = features.sparkSession
    per_fold = (
        _small(scores)
        if scores
        else spark.createDataFrame([], "model string, fold int, f1 double, auc double")
    )
    # A classifier keeps its row, without figures, when no fold has both classes to learn from.
    names = spark.createDataFrame([(n,) for n in settings.classifiers], "model string")
    means = per_fold.groupBy("model").agg(F.avg("f1").alias("f1_cv"), F.avg("auc").alias("auc_cv"))
    metrics = names.join(means, "model", "left")
    last = [t for n, k, t in tested if n == SERVED and k == settings.n_splits]
    nothing = spark.createDataFrame([], "y_true int, y_pred int")
    cells = _small([confusion_counts(last[0] if last else nothing)])
    report, matrix = report_from_counts(cells), matrix_from_counts(cells)

    for name, learner in settings.classifiers.items():
        if name in newton:
            continue
        final = replace(learner, depth=settings.final_depth.get(name, learner.depth))
        models[name] = fit(folded, inputs, LABEL, final)
    return ClassifierResult(models, inputs, metrics, report, matrix)
