"""Promotion of a challenger over the champion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The deciding metric per kind of model, and whether more is better.
DECIDING = {
    "classification": ("f1_score", True),
    "clustering": ("silhouette_score", True),
    "time_series": ("mae", False),
}


def promotes(
    challenger: Column, champion: Column, has_champion: Column, loadable: Column, higher_is_better: bool
) -> Column:
    """Whether the challenger takes over.

    A tie promotes, and so does a missing or unloadable champion. NaN never compares as better:
    in SQL it sorts above every number, so both sides are guarded.
    """
    better = challenger >= champion if higher_is_better else challenger <= champion
    return (
        F.when(~has_champion | ~F.coalesce(loadable, F.lit(False)), True)
        .when(F.isnan(challenger) | F.isnan(champion), False)
        .otherwise(F.coalesce(better, F.lit(False)))
    )


def promotion_decisions(
    challengers: DataFrame, champions: DataFrame, metric: str, higher_is_better: bool
) -> DataFrame:
    """Per model: both versions and scores and ``promote``.

    ``challengers`` has ``(model, version, <metric>)``; ``champions`` the same plus ``loadable``,
    with no row for a model that has no champion.
    """
    new = challengers.select(
        "model", F.col("version").alias("challenger_version"), F.col(metric).cast("double").alias("challenger_score")
    )
    old = champions.select(
        "model",
        F.col("version").alias("champion_version"),
        F.col(metric).cast("double").alias("champion_score"),
        "loadable",
    )
    decision = promotes(
        F.col("challenger_score"),
        F.col("champion_score"),
        F.col("champion_version").isNotNull(),
        F.col("loadable"),
        higher_is_better,
    )
    return new.join(old, "model", "left").withColumn("promote", decision).drop("loadable")


def decide(challenger: float, champion: float | None, loadable: bool, higher_is_better: bool) -> bool:
    """The same rule for one pair of numbers already on the driver."""
    if champion is None or not loadable:
        return True
    return challenger >= champion if higher_is_better else challenger <= champion
