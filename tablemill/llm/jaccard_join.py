"""Groups of near-duplicate documents: an exact Jaccard join with pivots and regions.

Jaccard distance is a metric. Two documents link when theirs is at most 1 - 0.75. Most documents are at
distance 1 from nearly all others, where no pivot tells them apart, so pivots are not drawn for the
whole corpus but for regions in which documents meet at all:

1. Documents with equal shingle sets are one class; only classes go on.
2. Shingles are ordered by hash. Linked documents share one of the first |x| - ceil(0.75 |x|) + 1 of
   each, the prefix; the zone below a fixed hash is added to it, so that in the zone both sides are
   complete. Shingles held by the very same classes are one region, with their number as weight.
3. The most central class of a region is its pivot: the one whose shingles have the most holders on
   average. Each class is measured against the pivot it shares most weight with (its Voronoi region), and
   links within the distance are made.
4. Where a region still holds several components, classes of different components are paired if their
   sizes allow a link, if the weight they share in the zone does, and, where both were measured against
   the same pivot, if their distances to it differ by no more than a link's (the triangle inequality's
   window; classes at a boundary appear with every region they belong to). Pairs are measured exactly.
5. A region with more than ``crowd`` classes would give a square of pairs. Such regions are put together
   by pivot. A pair that meets in them alone must reach the needed weight from them alone, and so must its
   smaller class. This one looks for larger partners of a size that can link, in as many of its regions,
   the emptiest first, as leave too little weight outside. Regions are joined block by block and exactly,
   with a product of incidence matrices, so that no task holds a region; classes of the commonest
   component are not joined with each other, and of a block's links only those come out that join
   components.

Every pair that links is measured or already in one component, so the components are exact.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.bytehash import Hashes, mix
from tablemill.llm.components import components
from tablemill.llm.store import ROW, Workspace, lean, numbered, tidy

WORDS = 5
PERCENT = 75
CROWD = 64
BLOCK = 512
LOAD = 1 << 20
STRIP = 4096
PASSES = 2  # over the shingles, each with its share of the shuffle files
PIECE = 1 << 18
ZONE = (1 << 62) - 1  # a quarter of all hashes


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word, in order. Words are what lies between ASCII white space, A-Z lower-cased."""
    data = text.encode().lower()
    out = []
    begin = 0
    while begin < len(data):
        end = len(data)
        if end - begin > PIECE:  # cut long texts between words
            stop = begin + PIECE
            while stop < end and data[stop] not in b" \t\n\r\x0b\x0c":
                stop += 1
            end = stop
        part = data[begin:end]
        code = np.frombuffer(part, dtype=np.uint8)
        ink = np.concatenate(([False], ~((code == 32) | ((code >= 9) & (code <= 13))), [False]))
        turn = np.flatnonzero(ink[1:] != ink[:-1])
        start, stop = turn[::2], turn[1::2]
        if len(start):
            out.append(Hashes(part).at(start, stop - start))
        begin = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes (not negative) of the shingles of ``words`` words; of fewer words, of all."""
    hashes = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    size = min(words, len(hashes))
    total = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = mix(total + hashes[i : len(hashes) - size + 1 + i])
    return np.unique((total >> np.uint64(1)).astype(np.int64))


def _sketches(words: int, percent: int):
    def run(batches):
        for batch in batches:
            out = []
            for row, text in zip(batch[ROW], batch["text"], strict=True):
                found = shingles(text, words)
                n = len(found)
                sums = mix(found.view(np.uint64)).sum(dtype=np.uint64) if n else np.uint64(0)
                key = int(mix(np.array([sums + np.uint64(n)], dtype=np.uint64))[0] >> np.uint64(1)) if n else None
                zone = int(np.searchsorted(found, ZONE, side="right"))
                prefix = n - -(-percent * n // 100) + 1 if n else 0
                out.append((row, n, zone, key, found[: max(prefix, zone)].copy()))
                if len(out) == 500:
                    yield pd.DataFrame(out, columns=[ROW, "n", "zone", "key", "prefix"])
                    out = []
            yield pd.DataFrame(out, columns=[ROW, "n", "zone", "key", "prefix"])

    return run


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.iloc[at : at + 500]
            yield pd.DataFrame({"key": part["key"], "body": [pack.compress(t.encode()) for t in part["text"]]})


def _measured(words: int):
    """How many shingles both texts have."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        last, known = None, None
        for batch in batches:
            out = []
            for a, b, one, other in zip(batch["a"], batch["b"], batch["body_a"], batch["body_b"], strict=True):
                if b != last:
                    last, known = b, shingles(unpack.decompress(other).decode(), words)
                mine = shingles(unpack.decompress(one).decode(), words)
                out.append((a, b, len(np.intersect1d(mine, known, assume_unique=True)), len(mine), len(known)))
            yield pd.DataFrame(out, columns=["a", "b", "both", "n_a", "n_b"])

    return run


def _measure(pairs: DataFrame, bodies: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b) with the sizes of their intersection and of both sets."""
    left = pairs.join(bodies.withColumnRenamed("key", "a").withColumnRenamed("body", "body_a"), "a")
    both = left.join(bodies.withColumnRenamed("key", "b").withColumnRenamed("body", "body_b"), "b")
    return both.select("a", "b", "body_a", "body_b").mapInPandas(lean("join", _measured(words)), "a long, b long, both long, n_a long, n_b long")


def _links(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def shared_counts(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``one`` has in common with each of ``other``.

    A product of two incidence matrices, over ``STRIP`` shingles at a time.
    """
    out = np.zeros((len(one), len(other)), dtype=np.int64)
    sides = [(np.repeat(np.arange(len(s)), [len(x) for x in s]), np.concatenate(s)) for s in (one, other)]
    common = np.intersect1d(sides[0][1], sides[1][1])
    if not len(common):
        return out
    placed = []
    for row, value in sides:
        place = np.searchsorted(common, value)
        kept = common[np.minimum(place, len(common) - 1)] == value
        row, place = row[kept], place[kept]
        order = np.argsort(place, kind="stable")
        placed.append((row[order], place[order]))
    for begin in range(0, len(common), STRIP):
        strips = []
        for (row, place), sets in zip(placed, (one, other), strict=True):
            low, high = np.searchsorted(place, [begin, begin + STRIP])
            strip = np.zeros((len(sets), min(STRIP, len(common) - begin)), dtype=np.float32)
            strip[row[low:high], place[low:high] - begin] = 1
            strips.append(strip)
        out += (strips[0] @ strips[1].T).astype(np.int64)
    return out


def _block_links(words: int, percent: int):
    """Links between the askers and the others of a block, as many as join its labels and no more."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        known = {k: shingles(unpack.decompress(b).decode(), words) for k, b in zip(frame["key"], frame["body"], strict=True)}
        asks = frame["asks"].to_numpy()
        key, label = frame["key"].to_numpy(), frame["label"].to_numpy()
        one, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = []
        if len(one) and len(other):
            both = shared_counts([known[k] for k in key[one]], [known[k] for k in key[other]])
            n = np.array([len(known[k]) for k in key])
            linked = (100 * both >= percent * (n[one][:, None] + n[other][None, :] - both)) & (label[one][:, None] != label[other][None, :])
            above: dict[int, int] = {}

            def root(x: int) -> int:
                while above.get(x, x) != x:
                    above[x] = above.get(above[x], above[x])
                    x = above[x]
                return x

            for i, j in np.argwhere(linked).tolist():
                x, y = root(int(label[one[i]])), root(int(label[other[j]]))
                if x != y:
                    above[x] = y
                    a, b = int(key[one[i]]), int(key[other[j]])
                    out.append((min(a, b), max(a, b)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _crowded_links(crowded: DataFrame, bodies: DataFrame, work: Workspace, words: int, percent: int) -> DataFrame:
    """Links of pairs that meet in crowded regions alone, from blocks of some ``BLOCK`` classes against each other.

    Within a region only classes of a size that can link meet: askers go to the band of their own size and
    to the next. Classes of the commonest label are in blocks of their own, which do not meet.
    """
    least = F.col("zone") - F.col("n") + (2 * percent * F.col("n") + F.lit(99 + percent)).cast("long") / (100 + percent)
    so_far = Window.partitionBy("key").orderBy("held", "region").rowsBetween(Window.unboundedPreceding, -1)
    asks = crowded.withColumn("least", F.floor(least - 1)).where("hot >= least")
    asks = asks.withColumn("before", F.coalesce(F.sum("in_zone").over(so_far), F.lit(0))).where("before <= hot - least")
    band = F.log("n") / F.lit(math.log(100 / percent))
    first, last = F.floor(band).cast("int"), F.floor(band + 1 + 1e-6).cast("int")
    asks = asks.withColumn("band", F.explode(F.sequence(first, last))).withColumn("asks", F.lit(True))
    columns = ["region", "band", "asks", "key", "n", "label"]
    rows = work.write(asks.select(*columns).unionByName(crowded.withColumn("band", first).withColumn("asks", F.lit(False)).select(*columns)))

    most = rows.groupBy("region", "band", "label").count().groupBy("region", "band").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
    rows = rows.join(most, ["region", "band"]).withColumn("main", F.col("label") == F.col("most"))

    def blocks(asking: bool, main: bool):
        chosen = (F.col("asks") == asking) & (F.col("main") == main)
        return F.ceil(F.greatest(F.count_if(chosen) / BLOCK, F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0)) / LOAD)).cast("int")

    sizes = rows.groupBy("region", "band").agg(
        blocks(True, False).alias("ask_few"), blocks(True, True).alias("ask_main"), blocks(False, False).alias("other_few"), blocks(False, True).alias("other_main")
    )
    placed = rows.join(sizes, ["region", "band"])
    few, main = F.when(F.col("asks"), F.col("ask_few")).otherwise(F.col("other_few")), F.when(F.col("asks"), F.col("ask_main")).otherwise(F.col("other_main"))
    own = F.pmod(F.xxhash64("key"), F.when(F.col("main"), main).otherwise(few)).cast("int") + F.when(F.col("main"), few).otherwise(0)
    facing_few = F.when(F.col("asks"), F.col("other_few")).otherwise(F.col("ask_few"))
    facing = facing_few + F.when(F.col("main"), 0).otherwise(F.when(F.col("asks"), F.col("other_main")).otherwise(F.col("ask_main")))
    placed = placed.select(*columns, own.alias("own"), facing.alias("facing")).where("facing > 0").join(bodies, "key")
    met = placed.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("facing") - 1)))
    met = met.select("region", "band", F.when(F.col("asks"), F.col("own")).otherwise(F.col("against")).alias("one"), F.when(F.col("asks"), F.col("against")).otherwise(F.col("own")).alias("other"), "asks", "key", "label", "body")
    return met.groupBy("region", "band", "one", "other").applyInPandas(_block_links(words, percent), "a long, b long")


def _pivot():
    """The most central class of a region."""
    return F.max_by("key", F.struct("central", "key")).alias("pivot")


def classes_and_links(docs: DataFrame, work: Workspace, words: int, percent: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs``, which are numbered, with set size and class, and the components of linked classes (node, label)."""
    rows = docs.select(ROW, F.col("text").cast("string").alias("text"))
    sketches = work.write(rows.mapInPandas(lean("join", _sketches(words, percent)), f"{ROW} long, n int, zone int, key long, prefix array<long>"))
    members = work.write(sketches.select(ROW, "n", "key"))
    classes = sketches.where("n > 0").groupBy("key").agg(F.min(ROW).alias(ROW), F.min("n").alias("n"), F.min("zone").alias("zone"), F.count("*").alias("copies"))
    classes = work.write(classes)

    # the shingles that more than one class has in its prefix or zone, and who has them
    spread = sketches.where("n > 0").select("key", F.explode("prefix").alias("shingle"))
    zone = F.sum((F.col("shingle") <= ZONE).cast("int"))
    parts = []
    for part in range(PASSES):
        mine = spread.where(F.pmod("shingle", F.lit(PASSES)) == part)
        # keys are mixed already; the same eight bytes three times over take no room in a shuffle file
        held = mine.groupBy("shingle").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.bit_xor("key").alias("who"), F.count("*").alias("holders"))
        held = work.write(held.where("first <> last").select("shingle", F.xxhash64("first", "last", "who").alias("region"), "holders"))
        tidy(docs.sparkSession)
        parts.append(work.write(mine.join(held, "shingle").groupBy("region", "key").agg(F.count("*").alias("weight"), zone.alias("in_zone"), F.sum("holders").alias("holders"))))
        work.drop(held)
    work.drop(sketches)
    met = functools.reduce(DataFrame.unionByName, parts).groupBy("region", "key").agg(*[F.sum(c).alias(c) for c in ("weight", "in_zone", "holders")])
    per_copy = [F.expr(f"{c} div copies").alias(c) for c in ("weight", "in_zone")]
    # a class is central when its shingles are held by many; what sets a copy apart is held by few
    central = (F.sum(F.col("holders") / F.col("copies")).over(Window.partitionBy("key")) / F.col("n")).cast("float").alias("central")
    met = work.write(met.join(classes.select("key", "n", "zone", "copies"), "key").select("region", "key", "n", "zone", *per_copy, central))
    work.drop(*parts)

    # only texts that meet another are measured
    some = met.select("key").distinct().join(classes, "key").select("key", ROW)
    bodies = work.write(rows.join(some, ROW).select("key", "text").mapInPandas(lean("join", _packed), "key long, body binary"))
    tidy(docs.sparkSession)

    pivots = met.groupBy("region").agg(_pivot())
    nearest = met.join(pivots, "region").where("key <> pivot").groupBy("key", "pivot").agg(F.sum("weight").alias("weight"), F.sum("in_zone").alias("in_zone"), F.min("n").alias("n"), F.min("zone").alias("zone"))
    # a hint only: with less, a class of its own size cannot link
    nearest = nearest.where(f"in_zone >= {2 * percent} * n div {100 + percent} - n + zone")
    nearest = nearest.groupBy("key").agg(F.max_by("pivot", F.struct("weight", "pivot")).alias("pivot"))
    first = work.write(_measure(nearest.select(F.col("key").alias("a"), F.col("pivot").alias("b")), bodies, words))
    links = _links(first, percent)
    labels = components(links, work)

    # distances to pivots, for the windows of the triangle inequality
    far = first.select(F.col("a").alias("key"), F.col("b").alias("centre"), (1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("far"))
    inside = met.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    several = inside.groupBy("region").agg(F.count("*").alias("held"), F.min("label").alias("low"), F.max("label").alias("high"), _pivot()).where("low <> high")
    open_ = work.write(inside.join(several.select("region", "held", "pivot"), "region").join(far, "key", "left"))

    quiet = open_.where(F.col("held") <= crowd).select("region", "key", "n", "zone", "in_zone", "label", "centre", "far")
    left = quiet.select("region", *[F.col(c).alias(f"{c}_a") for c in ("key", "n", "zone", "in_zone", "label", "centre", "far")])
    right = quiet.select("region", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "zone", "label", "centre", "far")])
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    apart = F.abs(F.col("far_a") - F.col("far_b")) > (100 - percent) / 100 + 1e-9
    window = ~F.coalesce((F.col("centre_a") == F.col("centre_b")) & apart, F.lit(False))
    pairs = left.join(right, "region").where((F.col("key_a") < F.col("key_b")) & (F.col("label_a") != F.col("label_b")) & (100 * small >= percent * large) & window)
    # what a pair shares in crowded regions is not known here, so it is allowed for in full
    hot = work.write(open_.where(F.col("held") > crowd).groupBy("key").agg(F.sum("in_zone").alias("hot")))
    shared = pairs.groupBy(F.col("key_a").alias("a"), F.col("key_b").alias("b")).agg(
        F.sum("in_zone_a").alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.first("zone_a").alias("zone_a"), F.first("zone_b").alias("zone_b")
    )
    shared = shared.join(hot.select(F.col("key").alias("a"), F.col("hot").alias("hot_a")), "a", "left").join(hot.select(F.col("key").alias("b"), F.col("hot").alias("hot_b")), "b", "left")
    reach = F.col("shared") + F.coalesce(F.least("hot_a", "hot_b"), F.lit(0))
    need = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent} - least(n_a - zone_a, n_b - zone_b)")
    chosen = shared.where(reach >= need).select("a", "b")

    # crowded regions of one pivot are one, or each pair would meet once for every shingle
    crowded = open_.where(F.col("held") > crowd).groupBy(F.col("pivot").alias("region"), "key").agg(*[F.first(c).alias(c) for c in ("n", "zone", "label")], F.sum("in_zone").alias("in_zone"))
    crowded = work.write(crowded.join(hot, "key"))
    crowded = crowded.join(crowded.groupBy("region").agg(F.count("*").alias("held")), "region")
    measured = _links(_measure(chosen, bodies, words), percent)
    second = work.write(measured.unionByName(_crowded_links(crowded, bodies, work, words, percent)))
    return members, components(links.unionByName(second), work)


def _grouped(docs: DataFrame, work: Workspace, words: int, percent: int, crowd: int) -> DataFrame:
    """By row of numbered ``docs``: size of the set, component, and whether it is the first row of its component."""
    members, labels = classes_and_links(docs, work, words, percent, crowd)
    named = docs.select(ROW, "doc_id").join(members, ROW)
    named = named.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("label", "key"))
    named = work.write(named.select(ROW, "doc_id", "n", "group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    least = named.where("group is not null").groupBy("group").agg(F.min(order).alias("least"))
    alone = F.col("group").isNull()
    return named.join(least, "group", "left").select(
        ROW,
        F.col("n").cast("long").alias("_op_n"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.id")).alias("_op_component"),
        (alone | (F.col("least.row") == F.col(ROW))).alias("_op_first"),
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """Adds n_shingles (size of the document's set) and component_id to every row.

    A document's set holds its distinct shingles of ``words`` words; with fewer words the whole sequence
    is one shingle. Documents link when 100 * intersection >= ``percent`` * union; component_id is the
    smallest doc_id reachable by links, itself included.

    A null, empty or blank text has an empty set and links with nothing. Equal rows link with each other.
    Where doc_id is null it does not count among a component's; with no other id, component_id is null. An
    empty table gives an empty one. Columns of the names added are replaced; names that begin with
    ``_op_`` are the operator's own. Shingles are compared as 63-bit hashes.
    """
    same = [c for c in docs.columns if c not in ("n_shingles", "component_id")]
    work = Workspace(docs.sparkSession, "near")
    rows = numbered(docs, work)
    told = _grouped(rows, work, words, percent, crowd)
    return rows.select(ROW, *same).join(told, ROW).select(*same, F.col("_op_n").alias("n_shingles"), F.col("_op_component").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, crowd: int = CROWD) -> DataFrame:
    """The rows that stay when each component keeps the one with the smallest doc_id (null ids last).

    Of rows that repeat that id one stays. Texts without words are in no component and stay.
    """
    work = Workspace(docs.sparkSession, "near")
    rows = numbered(docs, work)
    told = _grouped(rows, work, words, percent, crowd).where("_op_first")
    return rows.join(told.select(ROW), ROW).select(*docs.columns)
