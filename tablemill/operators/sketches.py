"""Daily profiles that add up: one row per day and column, with a quantile sketch, merged for any window.

A month's quartiles or drift read some thirty rows a column, not the month's log. Counts, sums, least and
greatest values are exact; ranks are within :func:`rank_error` of a share with 99 % probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.operators.joins import null_safe_join
from tablemill.operators.monitor import bin_distances, cumulative_distances

K = 800
#: What a daily row adds up from.
ADDED = ("rows", "nulls", "nans", "zeros", "n", "total", "squares")


def rank_error(k: int = K) -> float:
    """How far a rank may be off, as a share: the sketch's published bound for single ranks."""
    return 2.296 / k**0.9723


def daily_sketches(df: DataFrame, timestamp: str, columns: Sequence[str] | None = None, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """``(by.., day, column, rows, nulls, nans, zeros, n, total, squares, low, high, sketch)`` of numeric columns.

    One pass over all columns; tasks send a sketch for each day and column they meet, no values. n counts
    values that are neither null nor NaN, and total to sketch are theirs; without any, low, high and
    sketch are null. Rows without a timestamp are those of the day null.
    """
    by = list(by)
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in by]
    dated = df.select(*by, F.to_date(timestamp).alias("day"), *[F.col(c).cast("double").alias(c) for c in columns])

    def fields(c: str) -> Column:
        real = F.when(~F.isnan(c), F.col(c))
        return F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.count_if(F.isnan(c)).alias("nans"),
            F.count_if(real == 0).alias("zeros"),
            F.count(real).alias("n"),
            F.coalesce(F.sum(real), F.lit(0.0)).alias("total"),
            F.coalesce(F.sum(real * real), F.lit(0.0)).alias("squares"),
            F.min(real).alias("low"),
            F.max(real).alias("high"),
            F.when(F.count(real) > 0, F.kll_sketch_agg_double(real, F.lit(k))).alias("sketch"),
        )

    wide = dated.groupBy(*by, "day").agg(*[fields(c).alias(f"__{i}") for i, c in enumerate(columns)])
    return wide.select(*by, "day", F.inline(F.array(*[F.col(f"__{i}") for i in range(len(columns))])))


def merged(daily: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Daily rows added up to one row per ``by``, with mean and sd."""
    whole = daily.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ADDED],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.when(F.sum("n") > 0, F.kll_merge_agg_double("sketch")).alias("sketch"),
    )
    mean = F.try_divide("total", "n")
    spread = F.greatest(F.col("squares") - F.col("n") * mean * mean, F.lit(0.0))
    sd = F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1)))
    return whole.withColumns({"mean": mean, "sd": sd})


def _quantile(at: Sequence[float]) -> Column:
    """Quantiles of ``sketch``, as an array; null where there are no values."""
    found = F.array(*[F.kll_sketch_get_quantile_double(F.col("sketch"), F.lit(float(p))) for p in at])
    return F.when(F.col("sketch").isNotNull(), found)


def sketch_quantiles(whole: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Merged rows with a column for each of the named quantiles."""
    found = _quantile(list(shares.values()))
    return whole.withColumns({name: found[i] for i, name in enumerate(shares)})


def sketch_drift(baseline: DataFrame, current: DataFrame, points: int = 500, bins: int = 10) -> DataFrame:
    """``(column, n_base, n_cur, ks, wasserstein, psi, js)`` of two windows of daily rows, from their sketches alone.

    Each side stands for itself by ``points`` quantiles of equal weight, so a measure is off by the rank errors of
    both sketches and 1 / ``points``. psi and js compare shares between the baseline's quantiles, ``bins`` of
    them. Where a side has no values, the measures are null.
    """
    at = [(i + 0.5) / points for i in range(points)]
    sides = []
    for side, daily in (("base", baseline), ("cur", current)):
        edges = _quantile([i / bins for i in range(1, bins)]).alias("edges")
        sides.append(merged(daily).select("column", F.col("n").alias(f"n_{side}"), _quantile(at).alias(f"at_{side}"), *[edges] * (side == "base")))
    both = sides[0].join(sides[1], "column", "full")

    def weights(side: str) -> DataFrame:
        mine = both.where("at_base is not null and at_cur is not null")
        weight = [F.lit(int(side == s)).alias(s) for s in ("base", "cur")]
        return mine.select("column", F.explode(f"at_{side}").alias("value"), F.array_distinct("edges").alias("edges"), *weight)

    counts = weights("base").unionByName(weights("cur")).groupBy("column", "value").agg(F.sum("base").alias("base"), F.sum("cur").alias("cur"), F.first("edges").alias("edges"))
    # at most 2 * points rows of a column
    order = Window.partitionBy("column").orderBy("value")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.withColumns({"cum_base": F.sum("base").over(upto), "cum_cur": F.sum("cur").over(upto), "next_value": F.lead("value").over(order)})
    histogram = counts.withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("value")))).groupBy("column", "bin").agg(F.sum("base").alias("base"), F.sum("cur").alias("cur"))
    measured = cumulative_distances(cumulated).join(bin_distances(histogram, ["column"]), "column")
    sizes = [F.coalesce(f"n_{side}", F.lit(0)).alias(f"n_{side}") for side in ("base", "cur")]
    return both.select("column", *sizes).join(measured, "column", "left")


def touched_days(feed: DataFrame, timestamp: str) -> DataFrame:
    """The days that a change feed's rows lie on, before or after the change."""
    return feed.select(F.to_date(timestamp).alias("day")).distinct()


def refreshed(current: DataFrame, days: DataFrame, timestamp: str, columns: Sequence[str], k: int = K) -> DataFrame:
    """Daily rows of ``days`` (one row a day) over ``current``; a day without rows any more has counts of 0."""
    mine = null_safe_join(current.withColumn("__day", F.to_date(timestamp)), days.withColumnRenamed("day", "__day"), ["__day"], "left_semi", small=True)
    made = daily_sketches(mine, timestamp, columns, k=k)
    wanted = days.select("day", F.explode(F.array(*map(F.lit, columns))).alias("column"))
    out = null_safe_join(wanted, made, ["day", "column"], "left")
    zero = {c: F.lit(0.0) if c in ("total", "squares") else F.lit(0).cast("bigint") for c in ADDED}
    return out.select(*[F.coalesce(F.col(c), zero[c]).alias(c) if c in zero else F.col(c) for c in made.columns])
