"""Feature lookups: current value and point in time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.operators.ordered import CHUNK, range_chunks, spanning_rows
from tablemill.session import materialize


@dataclass(frozen=True)
class Lookup:
    """A feature table, unique on ``key``, and the columns wanted from it (default: all)."""

    table: DataFrame
    key: Sequence[str] | str
    columns: Sequence[str] | None = None

    @property
    def keys(self) -> list[str]:
        return [self.key] if isinstance(self.key, str) else list(self.key)


def training_set(
    entities: DataFrame,
    lookups: Sequence[Lookup],
    label: str | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Look the features of each entity row up, then drop ``exclude``.

    Left joins: an entity row never vanishes, a missing feature row gives nulls. The plan leaves
    the join strategy to AQE, which also splits a key that holds many entity rows. ``label=None``
    is the unsupervised form.
    """
    if label is not None and label not in entities.columns:
        raise ValueError(f"label {label!r} is not a column of the entity rows")
    joined = entities
    for lookup in lookups:
        keys = lookup.keys
        wanted = lookup.columns or [c for c in lookup.table.columns if c not in keys]
        taken = [c for c in wanted if c in joined.columns]
        if taken:
            raise ValueError(f"looked-up columns collide: {taken}")
        joined = joined.join(lookup.table.select(*keys, *wanted), keys, "left")
    return joined.drop(*exclude)


def asof_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    columns: Sequence[str],
    max_lookback_seconds: int | None = None,
    hot_rows: int | None = 2_000_000,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time, or nulls.

    Right rows with equal key and time are told apart by ``columns`` (the greatest wins). Keys with
    up to ``hot_rows`` rows are sorted within one task each. A key with more is cut into time
    ranges instead, so no task holds it whole; at most ``total / hot_rows`` keys can be that large.
    ``hot_rows=None`` skips the count.
    """
    on = list(on)
    taken = [c for c in [right_ts, *columns] if c in left.columns]
    if taken:
        raise ValueError(f"looked-up columns collide: {taken}")
    payload = F.struct(F.col(right_ts).alias("__rts"), *[F.col(c) for c in columns])
    left_row = F.struct(*[F.col(c) for c in left.columns if c not in on])
    keyless = F.lit(False)
    for k in on:
        keyless = keyless | F.col(k).isNull()
    lhs = left.select(*on, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), left_row.alias("__l"))
    rhs = right.dropna(subset=[*on, right_ts]).select(
        *on, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), payload.alias("__r")
    )
    # rows without a key match nothing and must not meet in one task
    both = lhs.filter(~keyless).unionByName(rhs, allowMissingColumns=True)
    unmatched = lhs.filter(keyless).drop("__side")

    hot = None
    if hot_rows is not None:
        hot = materialize(
            left.select(*on)
            .unionByName(right.select(*on))
            .dropna(subset=on)
            .groupBy(*on)
            .agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") > hot_rows)
            .select(*on),
            "hot-keys",
        )
        hot = None if hot.isEmpty() else F.broadcast(hot)
    if hot is None:
        matched = _asof_by_key(both, on)
    else:
        matched = _asof_by_key(both.join(hot, on, "left_anti"), on).unionByName(
            _asof_by_range(both.join(hot, on, "left_semi"), on)
        )

    matched = matched.unionByName(unmatched, allowMissingColumns=True)
    match = F.col("__m")
    if max_lookback_seconds is not None:
        # microseconds keep fractions of a second exact
        age = F.expr("timestampdiff(MICROSECOND, __m.__rts, __ts)")
        match = F.when(age <= F.lit(max_lookback_seconds * 1_000_000).cast("bigint"), match)
    kept = matched.select(*on, "__l", match.alias("__m"))
    own = [F.col(c) if c in on else F.col(f"__l.{c}").alias(c) for c in left.columns]
    looked_up = [F.col("__m.__rts").alias(right_ts), *[F.col(f"__m.{c}").alias(c) for c in columns]]
    return kept.select(*own, *looked_up)


def _asof_by_key(both: DataFrame, on: list[str]) -> DataFrame:
    order = Window.partitionBy(*on).orderBy("__ts", "__side", "__r")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__m", F.last("__r", ignorenulls=True).over(upto))
    return found.filter("__side = 1").select(*on, "__ts", "__l", "__m")


def _asof_by_range(both: DataFrame, on: list[str]) -> DataFrame:
    # The running number lets the range bounds fall between rows of one instant. It is written
    # before it decides where a row goes: a task that is run again might number its rows anew.
    numbered = materialize(both.withColumn("__no", F.monotonically_increasing_id()), "numbered")
    order = ["__ts", "__side", "__r", "__no"]
    chunked = range_chunks(numbered, order, on)
    # rows of the left side have no order value, and max_by passes over them
    last_right = F.max_by("__r", F.when(F.col("__side") == 0, F.struct("__ts", "__r")))
    per_chunk = spanning_rows(chunked, on).groupBy(*on, CHUNK).agg(last_right.alias("__c"))
    earlier = Window.partitionBy(*on).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        *on, CHUNK, F.last("__c", ignorenulls=True).over(earlier).alias("__carry")
    )
    inside = Window.partitionBy(*on, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = chunked.join(F.broadcast(carried), [*on, CHUNK], "left").withColumn(
        "__m", F.coalesce(F.last("__r", ignorenulls=True).over(upto), F.col("__carry"))
    )
    return found.filter("__side = 1").select(*on, "__ts", "__l", "__m")
