"""Exact top-k by integer inner product: a ball tree for each shard, searched by branch and bound.

Rows are dealt to shards at random. Each shard's vectors are split in two halves again and again at
the median of their projection on the line between two far points; a node keeps its centre and
radius, and for a query q no vector below it can score more than <q, centre> + |q| radius. The trees are
built once and written. A search begins at the root with a group of queries and goes on at the open node
of the highest bound, with those queries that may still find something there; a node that is left by all
of them is pruned with all that lies below it.

The shards share the kth score: first every query goes straight down to its best leaf in every shard, and
the kth highest of all scores found becomes the bound that every shard starts its search with.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.block_neighbours import chosen_places
from tablemill.llm.store import Workspace
from tablemill.llm.vectors import best, blocks, unpack, usable

SHARD_ROWS = 8192
SHARD_QUERIES = 4096
LEAF_ROWS = 128
FACTOR = 1024
LONG = np.iinfo(np.int64)
#: Rows with larger entries than this stay out of the balls, whose bounds doubles must hold; every query looks at them.
WILD = 2.0**200
FOUND = "qblock long, qplace int, query_id long, vec_id long, score long"
TREE = "shard int, dim int, places binary, block_of binary, ids binary, data binary, size int, centres binary, radii binary, links binary"


@dataclass
class Tree:
    """Nodes of a ball tree. ``links`` holds a node's two children, or -1, and its range of ``rows``."""

    rows: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    links: np.ndarray

    def wild(self) -> np.ndarray:
        """The rows that no ball holds."""
        return self.rows[self.links[0, 3] if len(self.links) else 0 :]


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(FACTOR * x) as doubles, each a whole number; infinite where a double cannot hold it."""
    with np.errstate(over="ignore"):
        return np.floor(x.astype(np.float64) * FACTOR)


def build(x: np.ndarray, leaf_rows: int) -> Tree:
    """The tree of scaled rows, root first."""
    tame = np.abs(x).max(axis=1, initial=0) <= WILD
    order = np.concatenate((np.flatnonzero(tame), np.flatnonzero(~tame)))
    held = int(tame.sum())
    centres, radii, links = [], [], []
    todo = [(0, held, -1, 0)] if held else []
    while todo:
        start, end, parent, side = todo.pop()
        rows = order[start:end]
        centre = x[rows].mean(axis=0)
        away = np.linalg.norm(x[rows] - centre, axis=1)
        if parent >= 0:
            links[parent][side] = len(links)
        centres.append(centre)
        # the bound must not fall short through rounding
        radii.append(float(away.max()) * (1 + 1e-9) + 1e-6)
        links.append([-1, -1, start, end])
        if end - start <= leaf_rows or away.max() == 0:
            continue
        one = x[rows[away.argmax()]]
        other = x[rows[np.linalg.norm(x[rows] - one, axis=1).argmax()]]
        order[start:end] = rows[np.argsort(x[rows] @ (other - one), kind="stable")]
        middle = start + (end - start) // 2
        todo += [(middle, end, len(links) - 1, 1), (start, middle, len(links) - 1, 0)]
    return Tree(order, np.array(centres).reshape(-1, x.shape[1]), np.array(radii), np.array(links, dtype="<i4").reshape(-1, 4))


def bounds(q: np.ndarray, lengths: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """What no row of a ball scores more than, for each query; infinite where doubles cannot tell."""
    with np.errstate(over="ignore", invalid="ignore"):
        reach = lengths * (radius + 1e-9 * (radius + np.linalg.norm(centre)))
        high = q @ centre + reach + 1e-6
    return np.where(np.isnan(high), np.inf, high)


def _whole(x: float) -> int:
    """floor(FACTOR * x) of any finite number."""
    return math.floor(x * FACTOR) if abs(x) < 2.0**60 else int(x) * FACTOR


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of scaled rows; those beyond 64 bits become the nearest long.

    ``q`` and ``x`` are original vectors. A pair is judged for itself: doubles hold the sums of small rows, longs
    those of larger ones, and Python's integers the rest.
    """
    a, b = scaled(q), scaled(x)
    most_a, most_b = np.abs(a).max(axis=1, initial=0), np.abs(b).max(axis=1, initial=0)
    exact, long = math.sqrt(2.0**53 / max(1, q.shape[1])), math.sqrt(2.0**62 / max(1, q.shape[1]))
    if max(most_a.max(initial=0), most_b.max(initial=0)) <= exact:
        return (a @ b.T).astype(np.int64)
    out = np.empty((len(a), len(b)), dtype=np.int64)
    fits_a, fits_b = np.flatnonzero(most_a <= long), np.flatnonzero(most_b <= long)
    out[np.ix_(fits_a, fits_b)] = a[fits_a].astype(np.int64) @ b[fits_b].astype(np.int64).T
    rest = np.ones(out.shape, dtype=bool)
    rest[np.ix_(fits_a, fits_b)] = False
    whole_a = {i: [_whole(v) for v in q[i].tolist()] for i in np.flatnonzero(rest.any(axis=1))}
    whole_b = {j: [_whole(v) for v in x[j].tolist()] for j in np.flatnonzero(rest.any(axis=0))}
    for i, j in zip(*np.nonzero(rest), strict=True):
        total = sum(v * w for v, w in zip(whole_a[i], whole_b[j], strict=True))
        out[i, j] = min(max(total, int(LONG.min)), int(LONG.max))
    return out


class Search:
    """The best ``k`` rows of a shard for a group of queries. ``own`` is a query's own row, or -1."""

    def __init__(self, tree: Tree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        self.tree, self.x, self.ids, self.q, self.own, self.kth, self.k = tree, x, ids, q, own, floor.copy(), k
        self.scaled = scaled(q)
        with np.errstate(over="ignore"):
            self.lengths = np.linalg.norm(self.scaled, axis=1)
        self.rows = [np.empty(0, dtype=np.int64)] * len(q)
        self.scores = [np.empty(0, dtype=np.int64)] * len(q)
        self.seen = 0  # bounds taken, one for each query and node

    def bound(self, node: int, who: np.ndarray) -> np.ndarray:
        self.seen += len(who)
        return bounds(self.scaled[who], self.lengths[who], self.tree.centres[node], self.tree.radii[node])

    def look(self, rows: np.ndarray, who: np.ndarray) -> None:
        """Score some rows for some queries."""
        if not (len(rows) and len(who)):
            return
        score = products(self.q[who], self.x[rows])
        fits = (score >= self.kth[who, None]) & (rows != self.own[who, None])
        for i in np.flatnonzero(fits.any(axis=1)):
            query = who[i]
            all_rows = np.concatenate((self.rows[query], rows[fits[i]]))
            all_scores = np.concatenate((self.scores[query], score[i][fits[i]]))
            top = best(self.ids[all_rows], all_scores, self.k)
            self.rows[query], self.scores[query] = all_rows[top], all_scores[top]
            if len(top) == self.k:
                self.kth[query] = max(self.kth[query], self.scores[query][-1])

    def dive(self) -> None:
        """Every query to its best leaf alone."""
        todo = [(0, np.arange(len(self.q)))] if len(self.tree.links) else []
        while todo:
            node, who = todo.pop()
            left, right, start, end = self.tree.links[node]
            if left < 0:
                self.look(self.tree.rows[start:end], who)
                continue
            goes_left = self.bound(left, who) >= self.bound(right, who)
            todo += [(child, some) for child, some in ((left, who[goes_left]), (right, who[~goes_left])) if len(some)]

    def run(self) -> None:
        """All leaves that may hold a result, nodes of the highest bound first."""
        everyone = np.arange(len(self.q))
        self.look(self.tree.wild(), everyone)
        heap = []

        def put(node: int, who: np.ndarray) -> None:
            high = self.bound(node, who)
            keep = high >= self.kth[who]
            if keep.any():
                heapq.heappush(heap, (-high[keep].max(), node, who[keep], high[keep]))

        if len(self.tree.links) and len(everyone):
            put(0, everyone)
        while heap:
            _, node, who, high = heapq.heappop(heap)
            who = who[high >= self.kth[who]]
            left, right, start, end = self.tree.links[node]
            if left < 0:
                self.look(self.tree.rows[start:end], who)
            elif len(who):
                put(left, who)
                put(right, who)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of every hit."""
        query = np.repeat(np.arange(len(self.q)), [len(r) for r in self.rows])
        return query, np.concatenate([*self.rows, np.empty(0, dtype=np.int64)]), np.concatenate([*self.scores, np.empty(0, dtype=np.int64)])


def _trees(dtype: str, leaf_rows: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """A shard's blocks as its tree: rows in the tree's order, with the block and place they come from."""
        parts = [(row["block"], *unpack(row, dtype)) for row in frame.to_dict("records")]
        block = np.concatenate([np.full(len(i), b, dtype="<i8") for b, i, _ in parts])
        place = np.concatenate([np.arange(len(i), dtype="<i4") for _, i, _ in parts])
        ids, x = np.concatenate([i for _, i, _ in parts]), np.concatenate([d for _, _, d in parts])
        tree = build(scaled(x), leaf_rows)
        at = tree.rows
        made = (frame["shard"].iloc[0], x.shape[1], place[at].tobytes(), block[at].tobytes(), ids[at].tobytes(), x[at].tobytes(), len(at))
        made += (tree.centres.astype("<f8").tobytes(), tree.radii.astype("<f8").tobytes(), tree.links.tobytes())
        return pd.DataFrame([made], columns=[c.split()[0] for c in TREE.split(", ")])

    return run


def _shard(k: int, dtype: str, first_only: bool):
    def run(key, tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if tree.empty or asked.empty:
            return pd.DataFrame(columns=["qblock", "qplace", "query_id", "vec_id", "score"])
        row = tree.iloc[0]
        ids, x = unpack(row, dtype)
        centres = np.frombuffer(row["centres"], dtype="<f8").reshape(-1, row["dim"])
        nodes = Tree(np.arange(len(ids)), centres, np.frombuffer(row["radii"], dtype="<f8"), np.frombuffer(row["links"], dtype="<i4").reshape(-1, 4))
        names = {key: i for i, key in enumerate(zip(np.frombuffer(row["block_of"], dtype="<i8").tolist(), np.frombuffer(row["places"], dtype="<i4").tolist(), strict=True))}
        qblock, qplace, qid, q, floor = [], [], [], [], []
        for ask in asked.to_dict("records"):
            some, data = unpack(ask, dtype)
            qblock.append(np.full(len(some), ask["block"]))
            qplace.append(np.frombuffer(ask["places"], dtype="<i4"))
            qid.append(some)
            q.append(data)
            floor.append(np.frombuffer(ask["floors"], dtype="<i8"))
        qblock, qplace, qid, q, floor = map(np.concatenate, (qblock, qplace, qid, q, floor))
        own = np.array([names.get(key, -1) for key in zip(qblock.tolist(), qplace.tolist(), strict=True)])
        search = Search(nodes, x, ids, q, own, floor, k)
        search.dive() if first_only else search.run()
        query, at, score = search.found()
        return pd.DataFrame({"qblock": qblock[query], "qplace": qplace[query].astype("int32"), "query_id": qid[query], "vec_id": ids[at], "score": score})

    return run


def _floors(k: int):
    """The kth score found so far for each query of a block, in the order of their places."""

    def run(batches):
        for batch in batches:
            floors = []
            for places, known in zip(batch["places"], batch["known"], strict=True):
                have = {} if known is None else {s["qplace"]: s["kth"] for s in known}
                floors.append(np.array([have.get(p, LONG.min) for p in np.frombuffer(places, dtype="<i4").tolist()], dtype="<i8").tobytes())
            batch["floors"] = floors
            yield batch.drop(columns="known")

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The ``k`` highest inner products of each query: query_id, rank, vec_id, score.

    Components count as floor(1024 * x). Queries are the rows whose vec_id is divisible by ``every``;
    candidates are all rows but the query's own. Ties go to the smaller vec_id; all candidates where
    there are fewer than ``k``. The result is exact.

    Rows whose id is null, or whose vector is null, empty or holds a null or non-finite component, take
    no part; zero vectors do. Vectors are compared with those of their own dimension. Of rows that
    repeat an id each is a query of its own and a candidate of the others. A score beyond 64 bits counts
    as the greatest or least long. An empty table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "top_k")
    x, kind = F.col("embedding"), dict(vectors.dtypes)["embedding"]
    dtype = "<f4" if kind == "array<float>" else "<f8"
    rows = vectors.select("vec_id", x if dtype == "<f4" else x.cast("array<double>").alias("embedding"))
    packed = work.write(blocks(rows.where(F.col("vec_id").isNotNull() & usable(x)), dtype))
    kinds = "block long, dim int, size int, ids binary, data binary, places binary"
    asks = work.write(packed.mapInPandas(chosen_places(lambda ids: ids % every == 0, dtype), kinds))
    shards = max(1, -(-(packed.agg(F.sum("size")).first()[0] or 0) // shard_rows))
    groups = max(1, -(-(asks.agg(F.sum("size")).first()[0] or 0) // SHARD_QUERIES))

    def dealt(n: int):
        return F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")

    def copies(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    trees = work.write(packed.withColumn("shard", dealt(shards)).groupBy("shard", "dim").applyInPandas(_trees(dtype, leaf_rows), TREE))
    keys = ["shard", "group", "dim"]
    stock = trees.select("*", copies(groups).alias("group")).groupBy(*keys)

    def found(known: DataFrame, first_only: bool) -> DataFrame:
        floors = asks.join(known, "block", "left").mapInPandas(_floors(k), kinds + ", floors binary")
        everywhere = floors.withColumn("group", dealt(groups)).select("*", copies(shards).alias("shard"))
        return stock.cogroup(everywhere.groupBy(*keys)).applyInPandas(_shard(k, dtype, first_only), FOUND)

    # ranks up to k are cut down in every task before the shuffle
    ranked = Window.partitionBy("qblock", "qplace").orderBy(F.col("score").desc(), "vec_id")
    nothing = asks.where("false").select("block", F.array().cast("array<struct<qplace:int,kth:bigint>>").alias("known"))
    scores = found(nothing, True).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    kth = scores.where(F.col("rank") == k).select(F.col("qblock").alias("block"), F.struct("qplace", F.col("score").alias("kth")).alias("one"))
    known = work.write(kth.groupBy("block").agg(F.collect_list("one").alias("known")))
    top = found(known, False).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score")
