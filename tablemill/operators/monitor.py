"""Profiles and drift of tables and scored logs, at daily grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.scalar import safe_share
from tablemill.operators.joins import null_safe_join
from tablemill.operators.ordered import (
    exact_quantiles,
    quantiles_of_cumulated,
    running_totals,
    value_counts,
)
from tablemill.session import materialize

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
# shares are floored here so that an empty bin does not make PSI infinite
SHARE_FLOOR = 1e-4


# -- profiles -------------------------------------------------------------------------------------


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    quantiles: str = "exact",
) -> DataFrame:
    """One row per (by, column): count, nulls, zeros, NaNs, distinct, mean, sd, min, max, quartiles.

    Moments take one pass over all columns. ``exact`` quartiles and distinct counts come from value
    counts in sorted ranges, so that no task holds a group's values; ``approx`` computes sketches
    of both in the same single pass and never shuffles values; ``none`` leaves them out. NaN counts
    as a value in ``nans`` only.
    """
    if quantiles not in ("exact", "approx", "none"):
        raise ValueError(f"unknown quantiles {quantiles!r}")
    by = list(by)
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in by]
    wide = df.groupBy(*by).agg(*[_moments(c, quantiles == "approx").alias(c) for c in columns])
    moments = wide.select(*by, F.inline(F.array(*[F.col(c) for c in columns])))
    if quantiles == "approx":
        split = {q: F.col("__quartiles")[i] for i, q in enumerate(QUARTILES)}
        return moments.withColumns(split).drop("__quartiles")
    if quantiles == "none":
        return moments
    counts = value_counts(df, columns, by)
    quart = exact_quantiles(counts, QUARTILES, [*by, "column"]).drop("n")
    joined = null_safe_join(moments, quart, [*by, "column"], "left")
    return joined.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)).cast("bigint"))


def _moments(c: str, sketches: bool) -> Column:
    value = F.col(c).cast("double")
    real = F.when(~F.isnan(value), value)
    fields = [
        F.lit(c).alias("column"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(value.isNull()).alias("nulls"),
        F.count_if(real == 0).alias("zeros"),
        F.count_if(F.isnan(value)).alias("nans"),
        F.avg(real).alias("mean"),
        F.stddev_samp(real).alias("sd"),
        F.min(real).alias("min"),
        F.max(real).alias("max"),
    ]
    if sketches:
        fields.append(F.approx_count_distinct(real).alias("n_distinct"))
        # one sketch per column answers all three
        fields.append(F.percentile_approx(real, list(QUARTILES.values())).alias("__quartiles"))
    return F.struct(*fields)


def with_day(df: DataFrame, timestamp: str, name: str = "day") -> DataFrame:
    """Add the start of the day window the row falls into."""
    return df.withColumn(name, F.date_trunc("day", timestamp))


def profile_log(
    log: DataFrame,
    timestamp: str = "inference_timestamp",
    prediction: str = "prediction",
    model: str = "model_version",
    problem_type: str = "classification",
    quantiles: str = "exact",
) -> DataFrame:
    """Daily profile of a scored log per model.

    ``classification``: count and share of each predicted class. ``regression``: the numeric
    profile of the predictions.
    """
    daily = with_day(log.select(timestamp, prediction, model), timestamp)
    if problem_type == "classification":
        counts = daily.groupBy("day", model, prediction).agg(F.count(F.lit(1)).alias("n"))
        return _with_share(counts, ["day", model], "n")
    if problem_type == "regression":
        return profile(daily, [prediction], ["day", model], quantiles)
    raise ValueError(f"unknown problem type {problem_type!r}")


def _with_share(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    # the totals have one row per window, whatever the number of classes in it
    totals = counts.groupBy(*by).agg(F.sum(n).alias("__total"))
    return null_safe_join(counts, totals, by).withColumn("share", F.col(n) / F.col("__total")).drop("__total")


def monitor_kind(table: str) -> str:
    """Which profile a table gets, by its name."""
    return "inference_log" if table == "inference_results" else "snapshot"


def monitor(df: DataFrame, table: str, **options) -> DataFrame:
    """The profile that fits ``table``."""
    return profile_log(df, **options) if monitor_kind(table) == "inference_log" else profile(df, **options)


def as_metric_rows(profiled: DataFrame, table: str, window: Column, metrics: Sequence[str]) -> DataFrame:
    """A profile as ``(table, window, column, metric, value)``, the key of the metric tables.

    Written with an upsert these rows make a repeated monitoring run harmless.
    """
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return profiled.select(
        F.lit(table).alias("table"), window.cast("string").alias("window"), "column", F.inline(pairs)
    )


# -- numeric drift --------------------------------------------------------------------------------


def side_counts(
    baseline: DataFrame, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """``(column, value, base, cur)``: value counts of both frames."""
    sides = baseline.select(*columns, F.lit(1).cast("bigint").alias("__base")).unionByName(
        current.select(*columns, F.lit(0).cast("bigint").alias("__base"))
    )
    weights = {"base": F.col("__base"), "cur": 1 - F.col("__base")}
    return value_counts(sides, columns, weights=weights)


def numeric_drift(
    baseline: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    bins: int = 10,
    edges: dict[str, Sequence[float]] | None = None,
) -> DataFrame:
    """One row per column: KS, Wasserstein-1, PSI, Jensen-Shannon distance.

    KS and Wasserstein compare the full distributions; PSI and JS compare histograms over
    ``edges``, by default the baseline's quantiles. Rows are summed by value once; everything
    after that works on value counts, which are written out because several steps read them.
    """
    cumulated = materialize(_cumulated_sides(baseline, current, columns), "cumulated")
    distance = cumulative_distances(cumulated)
    if edges is None:
        edges = baseline_edges(cumulated, bins)
    histogram = histogram_counts(cumulated, edges)
    return distance.join(bin_distances(histogram, ["column"]), "column")


def distribution_distances(
    baseline: DataFrame, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """KS and Wasserstein-1 distance per column, without histograms."""
    cumulated = materialize(_cumulated_sides(baseline, current, columns), "cumulated")
    return cumulative_distances(cumulated)


def _cumulated_sides(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = side_counts(baseline, current, columns)
    return running_totals(counts, ["value"], ["base", "cur"], ["column"], next_of="value")


def binned_drift(
    baseline: DataFrame, current: DataFrame, edges: dict[str, Sequence[float]]
) -> DataFrame:
    """PSI and Jensen-Shannon distance per column over given ``edges``, in one pass.

    Every task counts its rows by bin, so the shuffle carries a few rows per task. Edges may come
    from :func:`approx_edges`, from :func:`fixed_width_edges` or from an earlier run.
    """
    columns = list(edges)
    sides = baseline.select(*columns, F.lit(1).cast("bigint").alias("base")).unionByName(
        current.select(*columns, F.lit(0).cast("bigint").alias("base"))
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), _bin(F.col(c).cast("double"), edges[c]).alias("bin"))
            for c in columns
        ]
    )
    binned = sides.select("base", F.inline(pairs)).dropna(subset=["bin"])
    counts = binned.groupBy("column", "bin").agg(
        F.sum("base").alias("base"), F.sum(1 - F.col("base")).alias("cur")
    )
    return bin_distances(counts, ["column"])


def _bin(value: Column, inner: Sequence[float]) -> Column:
    """How many edges lie at or below the value; null for null and NaN."""
    # a short sum of comparisons stays in generated code, unlike an array lambda
    within = F.lit(0)
    for edge in inner:
        within = within + (value >= F.lit(float(edge))).cast("int")
    return F.when(value.isNotNull() & ~F.isnan(value), within)


def approx_edges(baseline: DataFrame, columns: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Inner quantile edges per column from sketches, in one pass without a shuffle of values."""
    at = [i / bins for i in range(1, bins)]
    row = baseline.agg(
        *[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), at).alias(c) for c in columns]
    ).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def cumulative_distances(cumulated: DataFrame) -> DataFrame:
    """KS and Wasserstein-1 per column of running totals on both sides."""
    # the last running total is the whole
    totals = cumulated.groupBy("column").agg(
        F.max("cum_base").alias("__nb"), F.max("cum_cur").alias("__nc")
    )
    gap = F.abs(
        safe_share(F.col("cum_base"), F.col("__nb")) - safe_share(F.col("cum_cur"), F.col("__nc"))
    )
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    return (
        cumulated.join(totals, "column")
        .groupBy("column")
        .agg(F.max(gap).alias("ks"), F.sum(gap * step).alias("wasserstein"))
    )


def baseline_edges(cumulated: DataFrame, bins: int = 10) -> dict[str, list[float]]:
    """Inner quantile edges of the baseline per column: at most ``bins - 1`` numbers each."""
    at = {f"e{i}": i / bins for i in range(1, bins)}
    rows = quantiles_of_cumulated(cumulated, at, ["column"], "base").collect()
    return {r["column"]: sorted({r[e] for e in at}) for r in rows}


def fixed_width_edges(low: float, high: float, width: float) -> list[float]:
    """Inner edges low + width, low + 2 width, .. below ``high``."""
    count = max(int((high - low) / width), 1)
    return [low + width * i for i in range(1, count + 1) if low + width * i < high]


def histogram_counts(cumulated: DataFrame, edges: dict[str, Sequence[float]]) -> DataFrame:
    """``(column, bin, base, cur)``; a value on an edge belongs to the bin above it."""
    bin_number = None
    for column, inner in edges.items():
        within = _bin(F.col("value"), inner)
        branch = F.col("column") == column
        bin_number = F.when(branch, within) if bin_number is None else bin_number.when(branch, within)
    return (
        cumulated.withColumn("bin", bin_number)
        .groupBy("column", "bin")
        .agg(F.sum("base").alias("base"), F.sum("cur").alias("cur"))
    )


def bin_distances(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """PSI and Jensen-Shannon distance per group of a two-sided histogram."""
    return _shares(histogram, by).groupBy(*by).agg(_psi().alias("psi"), _js().alias("js"))


def _shares(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = histogram.groupBy(*by).agg(F.sum("base").alias("__nb"), F.sum("cur").alias("__nc"))
    return (
        null_safe_join(histogram, totals, by)
        .withColumn("p", safe_share(F.col("base"), F.col("__nb")))
        .withColumn("q", safe_share(F.col("cur"), F.col("__nc")))
    )


def _psi() -> Column:
    p = F.greatest(F.col("p"), F.lit(SHARE_FLOOR))
    q = F.greatest(F.col("q"), F.lit(SHARE_FLOOR))
    return F.sum((q - p) * F.ln(q / p))


def _js() -> Column:
    middle = (F.col("p") + F.col("q")) / 2

    def half(share: Column) -> Column:
        return F.when(share > 0, share * F.log2(share / middle)).otherwise(F.lit(0.0))

    divergence = F.sum(half(F.col("p")) + half(F.col("q"))) / 2
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


# -- categorical drift ----------------------------------------------------------------------------


def category_counts(
    baseline: DataFrame, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """``(column, value, base, cur)`` of category columns; null is a category of its own."""

    def long(df: DataFrame, base: int) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
        )
        return df.select(F.inline(pairs)).withColumn("__base", F.lit(base).cast("bigint"))

    both = long(baseline, 1).unionByName(long(current, 0))
    return both.groupBy("column", "value").agg(
        F.sum("__base").alias("base"), F.sum(1 - F.col("__base")).alias("cur")
    )


def category_distances(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: chi-square with degrees of freedom, total variation, L-infinity, PSI, JS.

    A category the baseline lacks has no expected count: it is left out of chi-square and its rows
    are counted in ``unseen``.
    """
    expected = F.col("p") * F.col("__nc")
    squared = F.when(F.col("base") > 0, F.try_divide((F.col("cur") - expected) ** 2, expected))
    gap = F.abs(F.col("q") - F.col("p"))
    return (
        _shares(counts, by)
        .groupBy(*by)
        .agg(
            F.sum(squared).alias("chi_square"),
            (F.count_if(F.col("base") > 0) - 1).alias("df"),
            F.sum(F.when(F.col("base") == 0, F.col("cur")).otherwise(F.lit(0))).alias("unseen"),
            (F.sum(gap) / 2).alias("total_variation"),
            F.max(gap).alias("l_infinity"),
            _psi().alias("psi"),
            _js().alias("js"),
        )
    )


def categorical_drift(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per category column."""
    return category_distances(category_counts(baseline, current, columns), ["column"])


def consecutive_drift(
    df: DataFrame, window: str, value: str, by: Sequence[str] = ()
) -> DataFrame:
    """Each window against the one before it (the previous one that has rows), per ``by``.

    The frame is reduced to counts once; a window's counts then serve twice, as current and as the
    baseline of its successor.
    """
    by = list(by)
    counts = materialize(df.groupBy(*by, window, value).agg(F.count(F.lit(1)).alias("n")), "counts")
    # one row per window
    windows = counts.select(*by, window).distinct()
    order = Window.partitionBy(*by).orderBy(window)
    follows = windows.select(
        *by, F.lag(window).over(order).alias("__prev"), F.col(window).alias("__this")
    ).dropna(subset=["__prev"])
    zero = F.lit(0).cast("bigint")
    earlier = null_safe_join(follows.withColumnRenamed("__prev", window), counts, [*by, window])
    later = null_safe_join(follows.select(*by, F.col("__this").alias(window)), counts, [*by, window])
    both = earlier.select(*by, F.col("__this").alias(window), value, F.col("n").alias("base"), zero.alias("cur")).unionByName(
        later.select(*by, window, value, zero.alias("base"), F.col("n").alias("cur"))
    )
    summed = both.groupBy(*by, window, value).agg(F.sum("base").alias("base"), F.sum("cur").alias("cur"))
    return category_distances(summed, [*by, window])
