"""Group fairness and model documentation tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.functions.scalar import safe_share

METRICS = ("accuracy", "fpr", "fnr")
# The largest acceptable gap between groups, per metric.
MAX_GAPS = {"accuracy": 0.05, "fpr": 0.05}


def group_metrics(df: DataFrame, group: str, label: str, prediction: str) -> DataFrame:
    """Accuracy, false positive rate and false negative rate per group; 0/0 is null."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return df.groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((y == p).cast("double")).alias("accuracy"),
        safe_share(F.count_if((y == 0) & (p == 1)), F.count_if(y == 0)).alias("fpr"),
        safe_share(F.count_if((y == 1) & (p == 0)), F.count_if(y == 1)).alias("fnr"),
    )


def _long(metrics: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return metrics.select("group", F.inline(pairs)).dropna(subset=["value"])


def fairness_gaps(metrics: DataFrame, max_gaps: Mapping[str, float] = MAX_GAPS) -> DataFrame:
    """Per metric the largest difference between any two groups, who holds the ends, the verdict.

    A metric without a threshold has a null verdict.
    """
    limits = F.create_map(*[F.lit(v) for kv in max_gaps.items() for v in kv])
    ends = _long(metrics).groupBy("metric").agg(
        F.min(F.struct("value", "group")).alias("low"),
        F.max(F.struct("value", "group")).alias("high"),
    )
    gap = F.col("high.value") - F.col("low.value")
    limit = limits[F.col("metric")]
    return ends.select(
        "metric",
        F.col("low.group").alias("lowest"),
        F.col("high.group").alias("highest"),
        gap.alias("difference"),
        F.when(gap <= limit, "Yes").when(gap > limit, "No").alias("acceptable"),
    )


def against_reference(metrics: DataFrame, reference: str | None = None, max_gaps: Mapping[str, float] = MAX_GAPS) -> DataFrame:
    """Per metric and group the difference to one reference group, and the verdict.

    The reference is the group with the most rows, ties to the smaller name, unless ``reference`` names it. One row
    per metric is joined to the report, whose length grows with the groups, not with their pairs. The group
    null is compared but never chosen. A group the report does not have gives no rows, and neither does a metric that the reference has no value for.
    """
    long, limits = _long(metrics), F.create_map(*[F.lit(v) for kv in max_gaps.items() for v in kv])
    if reference is None:
        # one row: the largest group, with its metrics
        held = F.struct(*[F.col(m) for m in METRICS])
        largest = metrics.where("group is not null").agg(F.min(F.struct((-F.col("rows")).alias("n"), "group", held.alias("of"))).alias("first"))
        base = _long(largest.select("first.group", *[F.col(f"first.of.{m}").alias(m) for m in METRICS]))
    else:
        base = long.where(F.col("group") == reference)
    base = base.select("metric", F.col("group").alias("reference"), F.col("value").alias("reference_value"))
    gap = F.col("value") - F.col("reference_value")
    limit = limits[F.col("metric")]
    verdict = F.when(F.abs(gap) <= limit, "Yes").when(F.abs(gap) > limit, "No")
    both = long.join(F.broadcast(base), "metric").where(~F.col("group").eqNullSafe(F.col("reference")))
    return both.select("metric", "group", "reference", "value", "reference_value", gap.alias("difference"), verdict.alias("acceptable"))


def group_pairs(metrics: DataFrame, max_gaps: Mapping[str, float] = MAX_GAPS) -> DataFrame:
    """The report's pair table: each two groups once, with their difference per metric.

    It pairs rows of the finished report (one per group), not data rows. With many groups
    :func:`against_reference` and :func:`fairness_gaps` say the same without pairs.
    """
    long = _long(metrics)
    other = long.select("metric", F.col("group").alias("group_b"), F.col("value").alias("value_b"))
    limits = F.create_map(*[F.lit(v) for kv in max_gaps.items() for v in kv])
    gap = F.abs(F.col("value") - F.col("value_b"))
    limit = limits[F.col("metric")]
    return (
        long.join(other, "metric")
        .filter(F.col("group") < F.col("group_b"))
        .select(
            "metric",
            F.col("group").alias("group_a"),
            "group_b",
            F.col("value").alias("value_a"),
            "value_b",
            gap.alias("difference"),
            F.when(gap <= limit, "Yes").when(gap > limit, "No").alias("acceptable"),
        )
    )


def training_data_summary(df: DataFrame, timestamp: str) -> DataFrame:
    """Rows and date range of a training table."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(timestamp).alias("first_seen"),
        F.max(timestamp).alias("last_seen"),
    )


def performance_vs_threshold(scores: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """``(metric, value, threshold, met)`` from one row of scores."""
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m).cast("double").alias("value"),
                F.lit(float(t)).alias("threshold"),
                F.when(F.isnan(F.col(m)), False).otherwise(F.col(m) >= F.lit(float(t))).alias("met"),
            )
            for m, t in thresholds.items()
        ]
    )
    return scores.select(F.inline(rows))
