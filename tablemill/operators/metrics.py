"""Classification and forecast metrics as DataFrame aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.functions.scalar import safe_share
from tablemill.operators.ordered import running_totals


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """``(by.., label, prediction, count)``."""
    return df.groupBy(
        *by, F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("count"))


def accuracy(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    hit = (F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def classification_scores(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted F1 per group, from a confusion matrix.

    The class set is labels and predictions together; a class with neither support nor predictions
    adds nothing, and 0/0 counts as 0.
    """
    by = list(by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(F.lit(0))
    # each cell counts once towards its label's support and once towards its prediction's total
    sides = F.array(
        F.struct(F.col("label").alias("k"), F.col("count").alias("sup"), F.lit(0).cast("bigint").alias("pred"), hit.cast("bigint").alias("tp")),
        F.struct(F.col("prediction").alias("k"), F.lit(0).cast("bigint").alias("sup"), F.col("count").alias("pred"), F.lit(0).cast("bigint").alias("tp")),
    )
    per_class = (
        matrix.select(*by, F.inline(sides))
        .groupBy(*by, "k")
        .agg(F.sum("sup").alias("sup"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp"))
    )
    f1 = F.coalesce(safe_share(2 * F.col("tp"), F.col("sup") + F.col("pred")), F.lit(0.0))
    return per_class.groupBy(*by).agg(
        F.sum("sup").alias("rows"),
        safe_share(F.sum("tp"), F.sum("sup")).alias("accuracy"),
        (F.sum(F.col("sup") * f1) / F.sum("sup")).alias("f1_score"),
    )


def f1_weighted(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    scores = classification_scores(confusion_matrix(df, label, prediction, by), by)
    return scores.select(*by, "f1_score")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve of a binary label; ties count one half.

    The rows are first summed by score; running negatives come from :func:`running_totals`. With
    one class only, reading the result raises.
    """
    positive = (F.col(label) == 1).cast("bigint")
    by_score = (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    )
    ranked = running_totals(by_score, ["score"], ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    won = F.sum(F.col("pos") * (below + F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    # the error carries the column's type, so one expression serves both cases
    one_class = F.raise_error(F.lit("roc_auc needs both classes")).cast("double")
    return ranked.agg(F.when(F.coalesce(pairs, F.lit(0.0)) > 0, won / pairs).otherwise(one_class).alias("roc_auc"))


def forecast_errors(actual: str = "y", forecast: str = "yhat") -> list[Column]:
    """MAE, RMSE and MAPE (percent, rows with actual 0 left out, NaN when none remain)."""
    y, p = F.col(actual).cast("double"), F.col(forecast).cast("double")
    gap = y - p
    relative = F.when(y != 0, F.abs(F.try_divide(gap, y)))
    return [
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.coalesce(F.avg(relative) * 100, F.lit(float("nan"))).alias("mape"),
    ]


def forecast_scores(
    df: DataFrame, actual: str = "y", forecast: str = "yhat", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by).agg(*forecast_errors(actual, forecast))


def stack_predictions(df: DataFrame, models: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Several prediction columns as rows ``(keep.., model, prediction)``, in one pass."""
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("prediction"))
            for m, c in models.items()
        ]
    )
    return df.select(*keep, F.inline(pairs))


def compare_classifiers(df: DataFrame, label: str, models: Mapping[str, str]) -> DataFrame:
    """Accuracy and F1 of several models on the same rows: ``(model, rows, accuracy, f1_score)``."""
    stacked = stack_predictions(df, models, [label])
    return classification_scores(confusion_matrix(stacked, label, "prediction", ["model"]), ["model"])
