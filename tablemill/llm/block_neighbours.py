"""Nearest neighbours by inner product: a block matrix join with int8 tiles and error bounds.

Vectors are packed into blocks and rounded to int8 with one scale per vector. A tile multiplies a
group of query blocks with a group of candidate blocks. From the rounding errors follows how far a
tile's product can be from the true one,

    |<x, y> - <x', y'>| <= |x| |y - y'| + |y'| |x - x'|,

so a pair whose upper bound lies under the query's kth lower bound is out. What survives is computed
again from the original vectors in double precision, component after component. A tile hands on its
best ``k`` for each query as a sorted list, and heaps merge the lists of some tiles at a time.

Nothing is left to chance: the result is exact, not an estimate. The set of queries is a fixed share of
the rows, so the work grows with queries times rows; blocks bound what a task holds.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.store import Workspace
from tablemill.llm.vectors import blocks, unpack, usable

TILE_ROWS = 4096  # candidates of a tile
TILE_QUERIES = 4096
STRIP = 256  # queries multiplied at once
EXACT_DIM = 1024  # up to here float32 holds sums of int8 products exactly

FAN_IN = 64  # tiles whose lists are merged at once

FOUND = "qblock long, qplace int, query_id long, part int, vec_ids array<long>, scores array<double>"


def lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow or underflow of the squares."""
    most = np.abs(x).max(axis=1)
    most[(most == 0) | ~np.isfinite(most)] = 1.0
    return most * np.linalg.norm(x / most[:, None], axis=1)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the length of each rounding error, and the length of each rounded row."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, lengths(x - near), lengths(near)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, in float32 pieces that hold them."""
    total = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_DIM):
        total += a[:, d : d + EXACT_DIM].astype(np.float32) @ b[:, d : d + EXACT_DIM].astype(np.float32).T
    return total


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d].astype(np.float64) * b[:, d].astype(np.float64)
    return total


@np.errstate(over="ignore", invalid="ignore")
def tile(queries, candidates, k: int) -> pd.DataFrame:
    """The ``k`` best candidates of each query, one sorted list a query; both are (block, place, id, vector) arrays."""
    qb, qp, qid, q = queries
    cb, cp, cid, c = candidates
    q64, c64 = q.astype(np.float64), c.astype(np.float64)
    qcode, qscale, qerror, _ = quantised(q64)
    ccode, cscale, cerror, cnear = quantised(c64)
    qlength = lengths(q64)
    slack = 1e-9  # for the rounding of the bounds themselves
    out = []
    for at in range(0, len(q), STRIP):
        part = slice(at, at + STRIP)
        middle = int8_products(qcode[part], ccode) * qscale[part, None] * cscale
        error = (qlength[part, None] * cerror + qerror[part, None] * cnear) * (1 + slack) + slack * np.abs(middle) + 1e-12 * qlength[part, None] * cnear
        own = (qb[part, None] == cb) & (qp[part, None] == cp)
        # where doubles cannot hold the bounds nothing is known of a pair: it survives and lifts no other's bar
        held = np.isfinite(middle) & np.isfinite(error)
        low = np.where(own | ~held, -np.inf, middle - error)
        high = np.where(held, middle + error, np.inf)
        kth = np.partition(low, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(low), -np.inf)
        row, col = np.nonzero((high >= kth[:, None]) & ~own)
        score = exact(q[part][row], c[col])
        order = np.lexsort((cid[col], -score, ~np.isnan(score), row))
        row, col, score = row[order], col[order], score[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col, score = row[top], col[top], score[top]
        names, first = np.unique(row, return_index=True)
        lists = pd.DataFrame({"qblock": qb[names + at], "qplace": qp[names + at].astype("int32"), "query_id": qid[names + at]})
        lists["vec_ids"], lists["scores"] = np.split(cid[col], first[1:])[: len(names)], np.split(score, first[1:])[: len(names)]
        out.append(lists)
    return pd.concat(out, ignore_index=True)


def _side(frame: pd.DataFrame, dtype: str, chosen: bool):
    """Blocks one under the other; those of queries hold the chosen places only."""
    block, place, ids, data = [], [], [], []
    for row in frame.to_dict("records"):
        some, matrix = unpack(row, dtype)
        block.append(np.full(len(some), row["block"]))
        place.append(np.frombuffer(row["places"], dtype="<i4") if chosen else np.arange(len(some)))
        ids.append(some)
        data.append(matrix)
    return np.concatenate(block), np.concatenate(place), np.concatenate(ids), np.concatenate(data)


def _tiles(dtype: str, k: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["places"].notna()
        if asks.all() or not asks.any():
            return pd.DataFrame(columns=["qblock", "qplace", "query_id", "part", "vec_ids", "scores"])
        return tile(_side(frame[asks], dtype, True), _side(frame[~asks], dtype, False), k).assign(part=frame["part"].iloc[0])

    return run


def _merge(k: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Merge the sorted lists of each query of a block with a heap; a score that is no number leads, as in SQL."""
        out = []
        for (qplace, query_id), lists in frame.groupby(["qplace", "query_id"], sort=False):
            keyed = [[(not np.isnan(s), -s, v) for v, s in zip(r.vec_ids, r.scores, strict=True)] for r in lists.itertuples()]
            top = list(itertools.islice(heapq.merge(*keyed, key=lambda hit: (hit[0], hit[1] if hit[0] else 0.0, hit[2])), k))
            out.append((frame["qblock"].iloc[0], qplace, query_id, frame["part"].iloc[0], [v for _, _, v in top], [-s + 0.0 for _, s, _ in top]))
        return pd.DataFrame(out, columns=["qblock", "qplace", "query_id", "part", "vec_ids", "scores"])

    return run


def chosen_places(choose, dtype: str):
    """Blocks cut down to the vectors whose ids are chosen, and their places in the block."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                ids, data = unpack(row, dtype)
                at = np.flatnonzero(choose(ids)).astype("<i4")
                if len(at):
                    rows.append((row["block"], row["dim"], len(at), ids[at].tobytes(), data[at].tobytes(), at.tobytes()))
            yield pd.DataFrame(rows, columns=["block", "dim", "size", "ids", "data", "places"])

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, tile_rows: int = TILE_ROWS, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """The ``k`` nearest rows of each query by inner product: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the query's
    own. Nearest first, ties to the smaller vec_id; all candidates where there are fewer than ``k``.

    Rows whose id is null, or whose vector is null, empty, all zero or holds a null or non-finite
    component, take no part. Vectors are compared with those of their own dimension. Of rows that repeat
    an id each is a query of its own and a candidate of the others. Components may be of any finite
    size: a product beyond a double is infinite, and one of opposite infinities is not a number and
    counts as greater than all numbers, as in SQL. An empty table gives an empty result; columns other
    than vec_id and embedding are not looked at.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "neighbours")
    x = F.col("embedding")
    rows = vectors.select("vec_id", x.cast("array<double>").alias("embedding") if "double" in dict(vectors.dtypes)["embedding"] else x)
    dtype = "<f8" if "double" in dict(rows.dtypes)["embedding"] else "<f4"
    rows = rows.where(F.col("vec_id").isNotNull() & usable(x) & F.exists(x, lambda v: v != 0))
    packed = work.write(blocks(rows, dtype))

    schema = "block long, dim int, size int, ids binary, data binary, places binary"
    asks = work.write(packed.mapInPandas(chosen_places(lambda ids: ids % every == 0, dtype), schema))
    shape = packed.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-shape // tile_rows))
    groups = max(1, -(-shape // every // tile_queries))

    def dealt(column: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asks.select("*", dealt(F.col("block"), groups).alias("group")).select("*", copies(parts).alias("part"))
    right = packed.select("*", F.lit(None).cast("binary").alias("places"), dealt(F.col("block"), parts).alias("part")).select("*", copies(groups).alias("group"))
    found = left.unionByName(right).groupBy("group", "part", "dim").applyInPandas(_tiles(dtype, k), FOUND)
    # the tiles' lists of a query are merged some at a time, so no group grows with the table
    while True:
        found = found.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("qblock", "part").applyInPandas(_merge(k), FOUND)
        parts = -(-parts // FAN_IN)
        if parts == 1:
            break
        found = work.write(found)
    hits = found.select("query_id", F.posexplode(F.arrays_zip("vec_ids", "scores")).alias("rank", "hit"))
    return hits.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_ids").alias("vec_id"), F.col("hit.scores").alias("score"))
