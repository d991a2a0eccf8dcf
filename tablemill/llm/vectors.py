"""Vectors packed into blocks, so that a row of a shuffle is a matrix and not a vector."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
BLOCKS = "block long, dim int, size int, ids binary, data binary"


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def blocks(rows: DataFrame, dtype: str, convert: Callable[[np.ndarray], np.ndarray] = lambda x: x, size: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of up to ``size`` vectors of equal dimension, from rows (vec_id, embedding).

    A block's number is unique, so block and place name a row even where ids repeat. The result must
    be written before use: another run may pack the rows otherwise.
    """

    def run(batches):
        held: dict[int, list] = {}

        def packed(dim):
            ids, data = zip(*held.pop(dim), strict=True)
            return dim, len(ids), np.array(ids, dtype="<i8").tobytes(), convert(np.stack(data)).astype(dtype).tobytes()

        for batch in batches:
            out = []
            for vec_id, vector in zip(batch["vec_id"], batch["embedding"], strict=True):
                mine = held.setdefault(len(vector), [])
                mine.append((vec_id, np.asarray(vector)))
                if len(mine) == size:
                    out.append(packed(len(vector)))
            yield pd.DataFrame(out, columns=["dim", "size", "ids", "data"])
        yield pd.DataFrame([packed(d) for d in list(held)], columns=["dim", "size", "ids", "data"])

    made = rows.mapInPandas(run, "dim int, size int, ids binary, data binary")
    return made.select(F.monotonically_increasing_id().alias("block"), "*")


def unpack(row, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a block."""
    return np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["data"], dtype=dtype).reshape(row["size"], row["dim"])


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    # the least long has no negative
    falling = ~scores[some] if scores.dtype.kind == "i" else -scores[some]
    return some[np.lexsort((ids[some], falling))[:k]]
