"""Prediction intervals that widen with the horizon, from errors made at earlier origins.

A model fitted to all of a series says nothing about how its errors grow. So it is fitted again to what was
known at some earlier days (origins), and each fit forecasts the days that followed. All origins of all series are
one fit: a row belongs to each origin that lies on it or behind it, and the origin is one more key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.models.series import INTERVAL_Z, fit, predict
from tablemill.operators.joins import null_safe_join
from tablemill.session import materialize

ORIGIN = "__origin"


def horizon_errors(
    train: DataFrame,
    keys: Sequence[str],
    horizon: int,
    origins: int = 4,
    ds: str = "ds",
    y: str = "y",
    fit: Callable[..., DataFrame] = fit,
    predict: Callable[..., DataFrame] = predict,
) -> DataFrame:
    """``(keys.., step, variance)`` for steps 1 to ``horizon`` days after the end of what is known.

    Origins lie ``horizon`` days apart, the last one ``horizon`` days before the series' last row. variance is the mean
    squared error of forecasts that many days ahead, and never below that of fewer days. A step at which
    no origin has a row takes that of the step before, or else of the next one measured; a series too short for any origin has no rows.
    """
    if horizon < 1 or origins < 1:
        raise ValueError("the horizon and the number of origins must be at least 1")
    keys = list(keys)
    rows = train.dropna(subset=[ds, y]).select(*keys, F.col(ds).cast("date").alias("ds"), F.col(y).cast("double").alias("y"))
    last = rows.groupBy(*keys).agg(F.max("ds").alias("__last"), F.min("ds").alias("__first"))
    back = F.sequence(F.lit(1), F.lit(origins))
    cuts = last.select(*keys, "__first", F.explode(F.transform(back, lambda i: F.date_sub("__last", i * horizon))).alias(ORIGIN))
    cuts = cuts.where(F.col(ORIGIN) > F.col("__first")).drop("__first")
    folds = materialize(null_safe_join(rows, cuts, keys).where(F.col("ds") <= F.date_add(ORIGIN, horizon)), "folds")
    known = folds.where(F.col("ds") <= F.col(ORIGIN))
    ahead = folds.where(F.col("ds") > F.col(ORIGIN))
    said = predict(ahead, fit(known, [*keys, ORIGIN]), [*keys, ORIGIN])
    step = F.datediff("ds", ORIGIN).alias("step")
    found = said.select(*keys, step, ((F.col("y") - F.col("yhat")) ** 2).alias("e")).groupBy(*keys, "step").agg(F.avg("e").alias("e"))
    steps = found.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    # at most ``horizon`` rows of a series
    here = Window.partitionBy(*keys).orderBy("step")
    upto, onwards = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(0, Window.unboundedFollowing)
    variance = F.coalesce(F.max("e").over(upto), F.first("e", ignorenulls=True).over(onwards))
    return null_safe_join(steps, found, [*keys, "step"], "left").select(*keys, "step", variance.alias("variance"))


def widened(forecast: DataFrame, errors: DataFrame, last: DataFrame, keys: Sequence[str], ds: str = "ds", z: float = INTERVAL_Z) -> DataFrame:
    """``forecast`` with yhat_lower and yhat_upper of its horizon's errors in place of those it has.

    ``last`` (keys.., last_ds) names the day the model ends on. Days up to it get the bounds of one day ahead; days
    beyond the last step measured get variance in proportion to their horizon, as sums of daily shocks
    have. Bounds of a series without measured errors stay as they are.
    """
    keys = list(keys)
    table = errors.groupBy(*keys).agg(F.max("step").alias("__steps"), F.map_from_entries(F.collect_list(F.struct("step", "variance"))).alias("__v"))
    joined = null_safe_join(null_safe_join(forecast, last.select(*keys, "last_ds"), keys, "left"), table, keys, "left")
    step = F.greatest(F.datediff(F.col(ds), F.col("last_ds")), F.lit(1))
    inside = F.try_element_at("__v", F.least(step, F.col("__steps")))
    half = F.lit(z) * F.sqrt(inside * F.greatest(step / F.col("__steps"), F.lit(1.0)))
    bounds = {"yhat_lower": F.col("yhat") - half, "yhat_upper": F.col("yhat") + half}
    old = {c: F.coalesce(b, F.col(c)) if c in forecast.columns else b for c, b in bounds.items()}
    return joined.select(*[c for c in forecast.columns if c not in bounds], *[e.alias(c) for c, e in old.items()])
