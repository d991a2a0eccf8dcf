"""Equi-joins that keep rows whose key is null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False
) -> DataFrame:
    """Join on ``keys`` with null equal to null, as grouping has it.

    ``small`` broadcasts the right side; only for sides whose size has a bound.
    """
    names = {k: f"__key_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    if small:
        renamed = F.broadcast(renamed)
    same = reduce(and_, [left[k].eqNullSafe(renamed[n]) for k, n in names.items()])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())
