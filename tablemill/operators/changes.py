"""Change feed between two snapshots of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_feed(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that differ, with ``_change_type``.

    insert, delete, update_preimage or update_postimage. Both frames are unique on ``keys`` and
    have the same columns; the comparison treats null as equal to null.
    """
    columns = after.columns
    row = F.struct(*[F.col(c) for c in columns])
    old = before.select(*keys, row.alias("__old"))
    new = after.select(*keys, row.alias("__new"))
    changed = old.join(new, list(keys), "full").filter(~F.col("__old").eqNullSafe(F.col("__new")))

    def image(kind: str, side: str):
        return F.struct(F.lit(kind).alias("_change_type"), F.col(side).alias("__row"))

    images = (
        F.when(F.col("__old").isNull(), F.array(image("insert", "__new")))
        .when(F.col("__new").isNull(), F.array(image("delete", "__old")))
        .otherwise(
            F.array(image("update_preimage", "__old"), image("update_postimage", "__new"))
        )
    )
    return changed.select(F.inline(images)).select("__row.*", "_change_type")
