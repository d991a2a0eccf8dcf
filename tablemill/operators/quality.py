"""Expectations, de-duplication and data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

Rules = Mapping[str, str]


def holds(predicate: str) -> Column:
    """The SQL predicate as a boolean; a predicate that evaluates to null does not hold."""
    return F.coalesce(F.expr(predicate), F.lit(False))


def violation_counts(rules: Rules) -> list[Column]:
    """Aggregates for ``agg`` or ``observe``: rows seen and failures per rule."""
    failed = [F.count_if(~holds(p)).alias(f"failed_{name}") for name, p in rules.items()]
    return [F.count(F.lit(1)).alias("rows"), *failed]


def expect_or_drop(
    df: DataFrame, rules: Rules, observation: Observation | str | None = None
) -> DataFrame:
    """Keep the rows on which every rule holds.

    ``observation`` (an Observation for a batch, a name for a stream) collects
    :func:`violation_counts` in the same pass.
    """
    if observation is not None:
        df = df.observe(observation, *violation_counts(rules))
    for predicate in rules.values():
        # a filter drops rows on which it is null, and the plain form can be pushed to the reader
        df = df.filter(F.expr(predicate))
    return df


def expectation_report(df: DataFrame, rules: Rules) -> DataFrame:
    """One row per rule: ``(rule, passed, failed)``."""
    counted = df.agg(*violation_counts(rules))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                (F.col("rows") - F.col(f"failed_{name}")).alias("passed"),
                F.col(f"failed_{name}").alias("failed"),
            )
            for name in rules
        ]
    )
    return counted.select(F.inline(rows))


def dedup_by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None = None
) -> DataFrame:
    """One row per key: the first by ``order`` (default: all other columns, ascending, nulls first).

    The rank limit is applied in every map task before the shuffle, so a key with many copies
    sends one row per task.
    """
    order = list(order) if order else [c for c in df.columns if c not in keys] or list(keys)
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(ranked)).filter("__rn = 1").drop("__rn")


def clean(
    df: DataFrame,
    keys: Sequence[str],
    rules: Rules,
    sequence: str = "dedup_first",
    order: Sequence[Column | str] | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """De-duplicate and validate.

    ``dedup_first`` drops the key when its surviving copy breaks a rule, even if another copy was
    valid; ``validate_first`` keeps the first valid copy.
    """
    if sequence == "dedup_first":
        return expect_or_drop(dedup_by_key(df, keys, order), rules, observation)
    if sequence == "validate_first":
        return dedup_by_key(expect_or_drop(df, rules, observation), keys, order)
    raise ValueError(f"unknown sequence {sequence!r}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once or hold a null, with their count; empty for a valid key."""
    has_null = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return counted.filter((F.col("count") > 1) | has_null)


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise when ``keys`` is not a valid primary key of ``df``."""
    bad = duplicate_keys(df, keys).take(1)
    if bad:
        raise ValueError(f"key {list(keys)} is null or not unique, for example {bad[0].asDict()}")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: ``(column, nulls)``, in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]
    )
    return counted.select(F.inline(rows))


def describe_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column: count, mean, sample stddev, min, max, in one pass."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("stddev"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    return wide.select(F.inline(F.array(*[F.col(c) for c in columns])))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and share per target value, ordered by the value."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    # the total is one row, made from the same counts: the plan reuses their shuffle
    total = counts.agg(F.sum("count").cast("double").alias("total"))
    share = F.try_divide(F.col("count").cast("double"), total.scalar())
    return counts.withColumn("share", share).orderBy(target)


def preview(df: DataFrame, order: Sequence[Column | str], n: int = 100) -> DataFrame:
    """The first ``n`` rows by a total order, so that a repeat shows the same rows."""
    return df.orderBy(*order).limit(n)


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema as rows ``(position, column, type, nullable)``."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, type string, nullable boolean"
    )


def check_scored(source: DataFrame, scored: DataFrame, stamp: str = "inference_timestamp") -> None:
    """Raise unless ``scored`` has one row per input row and a stamp on every row."""
    rows_in = source.count()
    out = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(stamp).isNull()).alias("unstamped")
    ).first()
    if out["rows"] != rows_in:
        raise ValueError(f"{rows_in} rows in, {out['rows']} rows scored")
    if out["unstamped"]:
        raise ValueError(f"{out['unstamped']} scored rows have no {stamp}")
