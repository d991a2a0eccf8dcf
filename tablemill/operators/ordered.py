"""Running totals and ranks over a global order, without a one-task window.

A window with no partition key, or with a key that holds much of the table, runs in one task.
Here the rows are range-partitioned by (keys, order), each range ("chunk") is summed on its own,
and what lies in earlier chunks is added from a table that has at most two rows per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.joins import null_safe_join
from tablemill.session import materialize

CHUNK = "__chunk"


def range_chunks(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Range-partition by (keys, order) and pin the partition number in ``__chunk``.

    Chunks do not overlap and ascend with (keys, order). They are written out because a second
    evaluation could draw other range bounds.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return materialize(ranged, "chunks")


def spanning_rows(chunked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of those keys that may continue from one chunk into the next.

    Rows are sorted by key across chunks, so only the greatest key of a chunk can continue: at most
    one key per chunk, which bounds the broadcast side by the number of chunks.
    """
    if not keys:
        return chunked
    last_keys = (
        chunked.groupBy(CHUNK).agg(F.max(F.struct(*keys)).alias("k")).select("k.*").distinct()
    )
    return null_safe_join(chunked, last_keys, keys, "left_semi", small=True)


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Sequence[str],
    keys: Sequence[str] = (),
    next_of: str | None = None,
) -> DataFrame:
    """Add ``cum_<c>``, the sum of ``c`` over all rows up to and including this one.

    ``order`` must be unique within ``keys``. With ``next_of`` the column ``next_<c>`` holds that column's value in the following row of the same key.
    """
    keys = list(keys)
    chunked = range_chunks(df, order, keys)
    wanted = [F.sum(c).alias(f"__sum_{c}") for c in sums]
    if next_of:
        wanted.append(F.min(next_of).alias("__first"))
    per_chunk = spanning_rows(chunked, keys).groupBy(*keys, CHUNK).agg(*wanted)
    # one row per chunk and spanning key: this window is as small as the number of chunks
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"__sum_{c}").over(earlier).alias(f"__before_{c}") for c in sums]
    if next_of:
        carried.append(F.lead("__first").over(across).alias("__following"))
    offsets = per_chunk.select(*keys, CHUNK, *carried)
    joined = null_safe_join(chunked, offsets, [*keys, CHUNK], "left", small=True)

    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = [
        (F.sum(c).over(upto) + F.coalesce(F.col(f"__before_{c}"), F.lit(0))).alias(f"cum_{c}")
        for c in sums
    ]
    if next_of:
        added.append(
            F.coalesce(F.lead(next_of).over(inside), F.col("__following")).alias(f"next_{next_of}")
        )
    return joined.select(*df.columns, *added)


def row_numbers(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "rn"
) -> DataFrame:
    """``row_number()`` per key (or over the whole frame) without one task per key."""
    counted = running_totals(df.withColumn("__one", F.lit(1).cast("bigint")), order, ["__one"], keys)
    return counted.withColumnRenamed("cum___one", name).drop("__one")


def value_counts(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weights: dict | None = None
) -> DataFrame:
    """Long table ``(by.., column, value, n)``: how often each numeric value occurs.

    One pass for all columns; the shuffle carries distinct values, not rows. Nulls and NaN are
    left out. ``weights`` replaces the plain count by named sums of 0/1 expressions.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                for c in columns
            ]
        )
    )
    extra = [expr.alias(name) for name, expr in (weights or {}).items()]
    long = df.select(*by, *extra, pairs.alias("__p")).select(
        *by, *(weights or {}), "__p.column", "__p.value"
    )
    kept = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    totals = (
        [F.sum(name).alias(name) for name in weights] if weights else [F.count(F.lit(1)).alias("n")]
    )
    return kept.groupBy(*by, "column", "value").agg(*totals)


def exact_quantiles(
    counts: DataFrame, probabilities: dict[str, float], by: Sequence[str], n: str = "n"
) -> DataFrame:
    """Linearly interpolated quantiles of each group from its value counts.

    ``counts`` has one row per (by, value). The result has one row per group with the total ``<n>``,
    the number of distinct values ``n_distinct`` and one column per probability. Only the ranges
    that hold a wanted rank are sorted; all others are no more than summed.
    """
    by = list(by)
    occurring = counts.select(*by, "value", n).filter(F.col(n) > 0)
    chunked = range_chunks(occurring, ["value"], by)
    group = Window.partitionBy(*by)
    earlier = group.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # one row per chunk and group in it
    per_chunk = (
        chunked.groupBy(*by, CHUNK)
        .agg(F.sum(n).alias("__n"), F.count(F.lit(1)).alias("__values"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(group))
        .withColumn("__distinct", F.sum("__values").over(group))
    )
    holds_rank = F.lit(False)
    for p in probabilities.values():
        for rank in _ranks(p, F.col("__total")):
            after = F.col("__before") + F.col("__n")
            holds_rank = holds_rank | ((rank >= F.col("__before")) & (rank < after))
    wanted = per_chunk.filter(holds_rank).drop("__n", "__values")
    inside = Window.partitionBy(*by, CHUNK).orderBy("value")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = null_safe_join(chunked, wanted, [*by, CHUNK]).withColumn(
        "__cum", F.col("__before") + F.sum(n).over(upto)
    )
    totals = [F.max("__total").alias(n), F.max("__distinct").alias("n_distinct")]
    return _interpolated(ranked, probabilities, by, n, "__cum", "__total", totals)


def quantiles_of_cumulated(
    cumulated: DataFrame, probabilities: dict[str, float], by: Sequence[str], n: str
) -> DataFrame:
    """:func:`exact_quantiles` for counts that have their running total ``cum_<n>`` already."""
    by = list(by)
    occurring = cumulated.filter(F.col(n) > 0)
    sizes = occurring.groupBy(*by).agg(F.sum(n).alias("__total"))
    totals = [F.max("__total").alias(n), F.count(F.lit(1)).alias("n_distinct")]
    return _interpolated(
        null_safe_join(occurring, sizes, by), probabilities, by, n, f"cum_{n}", "__total", totals
    )


def _ranks(p: float, total: Column) -> tuple[Column, Column]:
    """The ranks, from 0, between which the quantile lies."""
    at = F.lit(float(p)) * (total - 1)
    return F.floor(at), F.ceil(at)


def _interpolated(
    ranked: DataFrame,
    probabilities: dict[str, float],
    by: list[str],
    n: str,
    cum: str,
    total: str,
    totals: list[Column],
) -> DataFrame:
    wanted = list(totals)
    for name, p in probabilities.items():
        for side, rank in zip(("lo", "hi"), _ranks(p, F.col(total))):
            reached = F.when(F.col(cum) > rank, F.col("value"))
            wanted.append(F.min(reached).alias(f"__{side}_{name}"))
    ends = ranked.groupBy(*by).agg(*wanted)

    def between(name: str, p: float) -> Column:
        at = F.lit(float(p)) * (F.col(n) - 1)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return ends.select(*by, n, "n_distinct", *[between(k, p) for k, p in probabilities.items()])
