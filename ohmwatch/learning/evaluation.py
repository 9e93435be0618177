"""Scores of regressions and classifiers as plain aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmwatch.operators.quantiles import auc


def regression_errors(
    df: DataFrame, keys: tuple[str, ...] = (), y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.expr(f"sqrt(avg(pow({y} - {p}, 2))) AS rmse"),
        F.expr(f"avg(abs({y} - {p})) AS mae"),
        F.count("*").alias("n"),
    )


def over_folds(per_fold: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return per_fold.groupBy(*keys).agg(
        F.avg("rmse").alias("cv_rmse_mean"),
        F.stddev_pop("rmse").alias("cv_rmse_std"),
        F.avg("mae").alias("cv_mae_mean"),
    )


def confusion_counts(
    df: DataFrame, keys: tuple[str, ...] = (), y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    """The four cells per key in one row."""
    return df.groupBy(*keys).agg(
        F.expr(f"count_if({y} = 1 AND {p} = 1) AS tp"),
        F.expr(f"count_if({y} = 0 AND {p} = 1) AS fp"),
        F.expr(f"count_if({y} = 1 AND {p} = 0) AS fn"),
        F.expr(f"count_if({y} = 0 AND {p} = 0) AS tn"),
    )


def f1_and_auc(
    df: DataFrame,
    keys: tuple[str, ...] = (),
    y: str = "y_true",
    p: str = "y_pred",
    score: str = "failure_proba",
) -> DataFrame:
    """F1 of the positive class (0 where undefined) and ROC AUC per key."""
    f1 = confusion_counts(df, keys, y, p).selectExpr(
        *keys, "coalesce(2D * tp / nullif(2 * tp + fp + fn, 0), 0D) AS f1"
    )
    area = auc(df, keys, score, y)
    if keys:
        return f1.join(area, list(keys), "left")
    one = [F.lit(0).alias("__one")]
    joined = f1.select("*", *one).join(area.select("*", *one), "__one", "left")
    return joined.drop("__one")


def matrix_from_counts(cells: DataFrame) -> DataFrame:
    return cells.selectExpr(
        "inline(array("
        "named_struct('actual', 0, 'predicted', 0, 'n', tn),"
        "named_struct('actual', 0, 'predicted', 1, 'n', fp),"
        "named_struct('actual', 1, 'predicted', 0, 'n', fn),"
        "named_struct('actual', 1, 'predicted', 1, 'n', tp)))"
    )


def confusion_matrix(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return matrix_from_counts(confusion_counts(df, (), y, p))


def classification_report(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return report_from_counts(confusion_counts(df, (), y, p))


def report_from_counts(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy and both averages."""

    def rate(top: str, bottom: str) -> str:
        return f"coalesce(1D * ({top}) / nullif({bottom}, 0), 0D)"

    scored = cells.selectExpr(
        "*",
        "tn + fp AS s0",
        "tp + fn AS s1",
        f"{rate('tn', 'tn + fn')} AS p0",
        f"{rate('tn', 'tn + fp')} AS r0",
        f"{rate('2 * tn', '2 * tn + fn + fp')} AS f0",
        f"{rate('tp', 'tp + fp')} AS p1",
        f"{rate('tp', 'tp + fn')} AS r1",
        f"{rate('2 * tp', '2 * tp + fn + fp')} AS f1",
        f"{rate('tp + tn', 'tp + tn + fp + fn')} AS acc",
    )

    def row(name: str, precision: str, recall: str, f1: str, support: str) -> str:
        return (
            f"named_struct('class', '{name}', 'precision', {precision}, 'recall', {recall}, "
            f"'f1', {f1}, 'support', {support})"
        )

    total = "(s0 + s1)"
    weighted = lambda k: f"({k}0 * s0 + {k}1 * s1) / {total}"
    rows = [
        row("0", "p0", "r0", "f0", "s0"),
        row("1", "p1", "r1", "f1", "s1"),
        row("accuracy", "acc", "acc", "acc", total),
        row("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", total),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
    ]
    return scored.filter(f"{total} > 0").selectExpr(f"inline(array({', '.join(rows)}))")


def report_table(report: DataFrame) -> DataFrame:
    return report.filter("class <> 'accuracy'")
