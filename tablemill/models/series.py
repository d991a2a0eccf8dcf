"""Seasonal forecasts of many daily series in one job.

A series is named by one or more key columns and has at most one row per day, so it is small; the
number of series is not. Fitting is a few grouped aggregates over all series together:
``yhat = (a + b * day) * weekly index * yearly index``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.joins import null_safe_join
from tablemill.operators.ordered import row_numbers
from tablemill.session import materialize

# two-sided 80 % of a normal distribution
INTERVAL_Z = 1.2816


def daily_index(
    df: DataFrame, order: Sequence[str], end: dt.date, keys: Sequence[str] = (), name: str = "ds"
) -> DataFrame:
    """Give the rows, in ``order``, consecutive days of which the last is ``end``.

    ``order`` must be unique per series. Works without a key and on a series that holds most rows. A long
    series begins before the year 1: Spark holds such days (years 0, -1, ...), Python's ``date`` does not, so
    they cannot be collected as dates. A series beyond Spark's days is an error.
    """
    numbered = row_numbers(df, order, keys, "__rn")
    if keys:
        sizes = numbered.groupBy(*keys).agg(F.max("__rn").alias("__n"))
        numbered = null_safe_join(numbered, sizes, keys)
    else:
        size = numbered.agg(F.max("__rn")).first()[0] or 0
        numbered = numbered.withColumn("__n", F.lit(size))
    back = F.col("__n") - F.col("__rn")
    room = (1 << 31) - 1
    back = F.when(back <= room, back.cast("int")).otherwise(F.raise_error(F.lit(f"a series has more than {room + 1} days")))
    return numbered.withColumn(name, F.date_sub(F.lit(end), back)).select(*df.columns, name)


def with_holdout(
    df: DataFrame, order: str, horizon: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``is_test``: the last ``horizon`` rows of each series by ``order`` (unique per series).

    A series that would keep no training row is an error.
    """
    if horizon < 1:
        raise ValueError("the horizon must be at least 1")
    keys = list(keys)
    if not keys:
        newest = df.select(order).orderBy(F.desc(order)).limit(horizon + 1).agg(
            F.count(F.lit(1)).alias("n"), F.min(order).alias("before")
        ).first()
        if newest["n"] <= horizon:
            raise ValueError(f"a series has no more than {horizon} rows")
        return df.withColumn("is_test", F.col(order) > F.lit(newest["before"]))
    # the row just before the hold-out; ranks beyond it are cut off before the shuffle
    latest = Window.partitionBy(*keys).orderBy(F.desc(order))
    ranked = df.select(*keys, order).withColumn("__rn", F.row_number().over(latest))
    before = ranked.filter(F.col("__rn") == horizon + 1).select(*keys, F.col(order).alias("__before"))
    short = null_safe_join(df.select(*keys).distinct(), before, keys, "left_anti").take(1)
    if short:
        raise ValueError(f"series {short[0].asDict()} has no more than {horizon} rows")
    marked = null_safe_join(df, before, keys).withColumn("is_test", F.col(order) > F.col("__before"))
    return marked.select(*df.columns, "is_test")


def tail_holdout(
    df: DataFrame, order: str, horizon: int, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of :func:`with_holdout`."""
    marked = with_holdout(df, order, horizon, keys)
    return marked.filter("NOT is_test").drop("is_test"), marked.filter("is_test").drop("is_test")


def future_frame(
    df: DataFrame, ds: str, horizon: int, keys: Sequence[str] = (), history: bool = True
) -> DataFrame:
    """``(keys.., ds)``: the days seen (if ``history``) and the ``horizon`` days after the last."""
    keys = list(keys)
    last = df.groupBy(*keys).agg(F.max(F.col(ds).cast("date")).alias("__last"))
    days = F.sequence(F.date_add("__last", 1), F.date_add("__last", horizon))
    ahead = last.select(*keys, F.explode(days).alias(ds))
    if not history:
        return ahead
    return df.select(*keys, F.col(ds).cast("date").alias(ds)).unionByName(ahead)


def day_number(ds: str) -> Column:
    """Days since 1970-01-01."""
    return F.datediff(F.col(ds), F.lit("1970-01-01").cast("date"))


def named_keys(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """The key columns; reading a null key raises, since plain joins would lose its rows."""
    kinds = dict(df.dtypes)
    lost = F.raise_error(F.lit("a series key is null"))
    return [F.coalesce(F.col(k), lost.cast(kinds[k])).alias(k) for k in keys]


def fit(
    train: DataFrame, keys: Sequence[str], ds: str = "ds", y: str = "y", yearly: bool = True
) -> DataFrame:
    """One row of coefficients per series: trend, weekly and yearly index, residual sd.

    The yearly index is fitted whatever a series' length, unless ``yearly`` is False.
    ``train`` holds one row per series and day; keys are not null. The rows and each step's small
    table are written once, so that no step is computed again inside the next.
    """
    keys = list(keys)
    daily = materialize(
        train.dropna(subset=[ds, y])
        .select(
            *named_keys(train, keys),
            F.col(ds).cast("date").alias("ds"),
            F.col(y).cast("double").alias("y"),
        )
        .withColumn("day", day_number("ds")),
        "series",
    )
    trend = materialize(
        daily.groupBy(*keys).agg(
            F.coalesce(F.regr_slope("y", "day"), F.lit(0.0)).alias("slope"),
            F.coalesce(F.regr_intercept("y", "day"), F.avg("y")).alias("intercept"),
            F.min("ds").alias("first_ds"),
            F.max("ds").alias("last_ds"),
            F.count(F.lit(1)).alias("n"),
        ),
        "trend",
    )
    sloped = daily.join(trend, keys).select(
        *keys,
        "y",
        (F.col("intercept") + F.col("slope") * F.col("day")).alias("line"),
        F.dayofweek("ds").alias("dow"),
        F.month("ds").alias("month"),
    )
    share = F.try_divide("y", "line")
    weekly = materialize(sloped.groupBy(*keys, "dow").agg(F.avg(share).alias("weekly")), "weekly")
    in_week = sloped.join(weekly, [*keys, "dow"]).withColumn("line", F.col("line") * F.col("weekly"))
    by_month = in_week if yearly else in_week.filter("false")
    monthly = materialize(by_month.groupBy(*keys, "month").agg(F.avg(share).alias("yearly")), "yearly")
    fitted = in_week.join(monthly, [*keys, "month"], "left")
    residual = F.col("y") - F.col("line") * F.coalesce("yearly", F.lit(1.0))
    sigma = fitted.groupBy(*keys).agg(F.stddev_samp(residual).alias("sigma"))

    def as_map(table: DataFrame, key: str, value: str) -> DataFrame:
        # at most 7 or 12 entries per series
        entries = F.collect_list(F.struct(key, value))
        return table.dropna(subset=[value]).groupBy(*keys).agg(F.map_from_entries(entries).alias(value))

    return (
        trend.join(as_map(weekly, "dow", "weekly"), keys, "left")
        .join(as_map(monthly, "month", "yearly"), keys, "left")
        .join(sigma, keys, "left")
    )


def predict(future: DataFrame, model: DataFrame, keys: Sequence[str], ds: str = "ds") -> DataFrame:
    """Add ``yhat``, ``yhat_lower`` and ``yhat_upper`` to the rows of ``future``.

    A series the model does not know gets nulls.
    """
    keys = list(keys)
    wanted = ["slope", "intercept", "weekly", "yearly", "sigma"]
    coefficients = model.select(*keys, F.struct(*wanted).alias("__m"))
    joined = future.join(coefficients, keys, "left")

    def index(which: str, at):
        return F.coalesce(F.try_element_at(F.col(f"__m.{which}"), at), F.lit(1.0))

    line = F.col("__m.intercept") + F.col("__m.slope") * day_number(ds)
    yhat = line * index("weekly", F.dayofweek(ds)) * index("yearly", F.month(ds))
    half = F.lit(INTERVAL_Z) * F.coalesce(F.col("__m.sigma"), F.lit(0.0))
    return joined.select(*future.columns, yhat.alias("yhat"), half.alias("__half")).select(
        *future.columns,
        "yhat",
        (F.col("yhat") - F.col("__half")).alias("yhat_lower"),
        (F.col("yhat") + F.col("__half")).alias("yhat_upper"),
    )
