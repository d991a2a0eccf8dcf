"""Forecasts with a trend that may bend, for many daily series in one job.

``yhat = g(t) + line(t) * season(t)``: g is a straight line with a change of slope at each of a number of
points spread evenly over the first part of the history; the season is weekly and yearly Fourier terms, in
proportion to the series' plain regression line. All coefficients are fitted together by ridge-regularised normal
equations. The design of a row is a column expression, the same for fitting and for predicting; the Gram
matrix of a series is a grouped aggregate over its rows, of which there is one a day.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.models.series import INTERVAL_Z, day_number, named_keys
from tablemill.operators.joins import null_safe_join
from tablemill.session import materialize

#: On intercept and slope, so that the equations of a series of one day can be solved.
FIRM = 1e-9


@dataclass(frozen=True)
class Shape:
    """What the trend and the season are made of, and how strongly each is held back.

    ``changes`` points lie evenly within the first ``reach`` of the history. Orders of 0 leave a season out.
    """

    changes: int = 25
    reach: float = 0.8
    weekly: int = 3
    yearly: int = 10
    trend_ridge: float = 0.05
    season_ridge: float = 0.01

    def points(self) -> list[float]:
        """Change points as shares of the history."""
        return [self.reach * (k + 1) / (self.changes + 1) for k in range(self.changes)]

    def penalties(self) -> list[float]:
        terms = 2 * (self.weekly + self.yearly)
        return [FIRM, FIRM, *[self.trend_ridge] * self.changes, *[self.season_ridge] * terms]

    def design(self, t: Column, day: Column, line: Column) -> list[Column]:
        """A row's terms: ``t`` is its place in the history (0 to 1), ``line`` the plain line there."""
        out = [F.lit(1.0), t]
        out += [F.greatest(t - F.lit(p), F.lit(0.0)) for p in self.points()]
        for period, order in ((7.0, self.weekly), (365.25, self.yearly)):
            for k in range(1, order + 1):
                angle = F.lit(2 * math.pi * k / period) * day
                out += [line * F.sin(angle), line * F.cos(angle)]
        return out


def solve(terms: np.ndarray, y: np.ndarray, penalties: np.ndarray) -> np.ndarray:
    """Coefficients that minimise the squared error plus the weighted squares of the coefficients."""
    return np.linalg.solve(terms.T @ terms + np.diag(penalties), terms.T @ y)


def _places(rows: DataFrame, facts: str = "") -> dict[str, Column]:
    """t, day and line of a row that has its series' facts beside it, in units of the series' scale."""
    at = F.col(f"{facts}first_day"), F.col(f"{facts}last_day")
    t = (F.col("__day") - at[0]) / F.greatest(at[1] - at[0], F.lit(1))
    line = (F.col(f"{facts}intercept") + F.col(f"{facts}slope") * F.col("__day")) / F.col(f"{facts}scale")
    return {"t": t, "day": F.col("__day").cast("double"), "line": line}


def fit_trend(train: DataFrame, keys: Sequence[str], ds: str = "ds", y: str = "y", shape: Shape = Shape()) -> DataFrame:
    """One row per series: its line, its scale, the coefficients of ``shape`` and the residual sd.

    ``train`` holds one row per series and day; keys are not null, rows without a day or value are left out.
    A shuffle carries key, day and value; the terms are made behind it.
    """
    keys = list(keys)
    rows = train.dropna(subset=[ds, y]).select(
        *named_keys(train, keys), day_number(ds).alias("__day"), F.col(y).cast("double").alias("__y")
    )
    daily = materialize(rows, "trend")
    facts = daily.groupBy(*keys).agg(
        F.min("__day").alias("first_day"),
        F.max("__day").alias("last_day"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.nullif(F.max(F.abs("__y")), F.lit(0.0)), F.lit(1.0)).alias("scale"),
        F.coalesce(F.regr_slope("__y", F.col("__day").cast("double")), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("__y", F.col("__day").cast("double")), F.avg("__y")).alias("intercept"),
    )
    facts = materialize(facts, "facts")
    penalties = np.array(shape.penalties())

    @F.pandas_udf("array<double>")
    def coefficients(terms: pd.Series, value: pd.Series) -> list[float]:
        x, z = np.stack(terms.to_numpy()), value.to_numpy()
        beta = solve(x, z, penalties)
        left = z - x @ beta
        # the residual sd rides along as the last entry
        spread = float(np.std(left, ddof=1)) if len(z) > 1 else float("nan")
        return [*beta.tolist(), spread]

    joined = daily.join(facts, keys)
    terms = F.array(*shape.design(**_places(joined)))
    fitted = joined.groupBy(*keys).agg(coefficients(terms, F.col("__y") / F.col("scale")).alias("__b"))
    count = len(penalties)
    sigma = F.nanvl(F.element_at("__b", -1), F.lit(None)) * F.col("scale")
    return facts.join(fitted, keys).select(*keys, *[c for c in facts.columns if c not in keys], F.slice("__b", 1, count).alias("beta"), sigma.alias("sigma"))


def predict_trend(future: DataFrame, model: DataFrame, keys: Sequence[str], ds: str = "ds", shape: Shape = Shape()) -> DataFrame:
    """Add ``yhat``, ``yhat_lower`` and ``yhat_upper`` to the rows of ``future``.

    ``shape`` is that of the fit. Behind the last change point the trend goes on as it was; a series the
    model does not know gets nulls.
    """
    keys = list(keys)
    wanted = ["first_day", "last_day", "scale", "slope", "intercept", "beta", "sigma"]
    coefficients = model.select(*keys, F.struct(*wanted).alias("__m"))
    joined = null_safe_join(future, coefficients, keys, "left").withColumn("__day", day_number(ds))
    terms = shape.design(**_places(joined, "__m."))
    total = F.lit(0.0)
    for i, term in enumerate(terms):
        total = total + F.col("__m.beta")[i] * term
    half = F.lit(INTERVAL_Z) * F.coalesce(F.col("__m.sigma"), F.lit(0.0))
    out = joined.select(*future.columns, (total * F.col("__m.scale")).alias("yhat"), half.alias("__half"))
    return out.select(*future.columns, "yhat", (F.col("yhat") - F.col("__half")).alias("yhat_lower"), (F.col("yhat") + F.col("__half")).alias("yhat_upper"))


def change_points(model: DataFrame, keys: Sequence[str], shape: Shape = Shape()) -> DataFrame:
    """``(keys.., ds, change)``: the days on which the slope may change, and by how much a day it does."""
    span = F.greatest(F.col("last_day") - F.col("first_day"), F.lit(1))
    points = F.array(*[F.struct(F.lit(p).alias("p"), F.col("beta")[2 + i].alias("b")) for i, p in enumerate(shape.points())])
    long = model.select(*keys, "first_day", span.alias("span"), "scale", F.inline(points))
    when = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("first_day") + F.round(F.col("p") * F.col("span"))).cast("int"))
    return long.select(*keys, when.alias("ds"), (F.col("b") * F.col("scale") / F.col("span")).alias("change"))
