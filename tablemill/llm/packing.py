"""Packing of token sequences by length patterns and non-negative least squares.

What has to be packed is described by a histogram of lengths, which is no longer than a sequence however
large the corpus is. Patterns of a few lengths that fill a sequence are enumerated, and least squares with
coefficients of zero or more finds how often to use each so that they give the histogram. Rounded down,
they take up most documents; what remains is packed best-fit, the longest first. Documents then take the
places of their length in turn, each knowing its number among those of its length.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablemill.llm.store import ROW, Workspace, give_back, kept, numbered

CAPACITY = 2048
STEPS = 400
DEALS = 64  # parts in which the pieces of one length are numbered
CHARS = 1 << 21  # of texts encoded together
WORDS = 1 << 19  # remembered
STEP = 1 << 14


class Encoder:
    """Ids of texts, with the words met lately remembered.

    The tokenizer splits text before a space that stands between two visible characters whatever is
    around it, so what lies between such spaces can be encoded on its own. With ``ranks``, the same
    vocabulary as a table of ranks, that library encodes, which is faster; the ids are equal. It tells words
    of one long text apart by their length in bytes.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.path = path
        with open(path, encoding="utf-8") as file:
            text = file.read()
        at = text.index('"added_tokens"')
        self.special = [t["content"] for t in json.JSONDecoder().raw_decode(text, text.index("[", at))[0]]
        self.fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.sizes = np.zeros(max(table.values()) + 1, dtype=np.int64)
            self.sizes[list(table.values())] = [len(b) for b in table]
        self.forget()

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.begins = np.empty(0, "<u4"), np.zeros(1, np.int64)  # ids of known words, and where each word's begin

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special tokens, each on its own."""
        if self.fast:
            return [self.fast.encode_to_numpy(t) for t in texts]
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words behind a space, one after the other, and how many each has."""
        if not self.fast:
            found = self.encode([f" {w}" for w in words])
            return np.concatenate([*found, np.empty(0, "<u4")]), np.fromiter(map(len, found), np.int64, len(found))
        ids = self.fast.encode_to_numpy("".join([f" {w}" for w in words]))
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        return ids, np.diff(stops, prepend=0)

    @staticmethod
    def even(text: str) -> bool:
        """Whether all white space is single spaces and line ends between visible characters."""
        return all(line and " ".join(line.split()) == line for line in text.split("\n"))

    def of_words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of even texts."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begins = lists.offsets.to_numpy()
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > WORDS:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            ids, counts = self.encode_words(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.pool = np.concatenate((self.pool, ids.astype("<u4")))
            self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(counts)))
        code = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))[coded.indices.to_numpy()]
        # a text's first word has no space before it
        firsts = self.encode(flat.take(pa.array(begins[:-1])).to_pylist())
        code[begins[:-1]] = len(self.known) + np.arange(len(texts))
        pool = np.concatenate([self.pool, *firsts]).astype("<u4")
        starts = np.concatenate((self.begins, self.begins[-1] + np.cumsum([len(f) for f in firsts]))).astype(np.int32)
        out = []
        turn = np.flatnonzero(np.diff(begins[:-1] // STEP)) + 1  # texts of some STEP words together
        for lo, hi in zip([0, *turn], [*turn, len(texts)], strict=True):
            mine = code[begins[lo] : begins[hi]]
            size = starts[mine + 1] - starts[mine]
            ends = np.cumsum(size, dtype=np.int32)
            place = np.repeat(starts[mine] - (ends - size), size)
            place += np.arange(ends[-1], dtype=np.int32)
            out += np.split(pool[place], ends[begins[lo + 1 : hi] - begins[lo] - 1])
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
            elif self.even(text):
                plain.append(i)
            else:
                (out[i],) = self.encode([text])
        if plain:
            for i, found in zip(plain, self.of_words([texts[i] for i in plain]), strict=True):
                out[i] = found
        return out


def encoder(path: str, ranks: str | None) -> Encoder:
    return kept("packing", Encoder, path, ranks)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces; only the first may be shorter than ``capacity``."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(path: str, ranks: str | None, capacity: int, with_ids: bool):
    names = [ROW, "part", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        encode = encoder(path, ranks)
        for batch in batches:
            rows, parts, texts = batch[ROW].tolist(), batch["part"].tolist(), [t or "" for t in batch["text"]]
            # texts of some CHARS characters together, a longer one alone
            turn = np.cumsum([len(t) for t in texts]) // CHARS
            for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(turn)) + 1):
                columns: list[list] = [[] for _ in names]
                for i, found in zip(part.tolist(), encode.ids([texts[i] for i in part]), strict=True):
                    row, data = rows[i], found.astype("<u4").tobytes() + bytes(4)  # id 0 ends it
                    for number, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        piece = data[4 * start : 4 * (start + length)]
                        made = (row, parts[i], number, start, length, zlib.crc32(piece), *[np.frombuffer(piece, "<i4")] * with_ids)
                        for column, value in zip(columns, made, strict=True):
                            column.append(value)
                yield pd.DataFrame(dict(zip(names, columns, strict=True)))
        give_back()

    return run


# -- patterns -------------------------------------------------------------------------------------


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: patterns of lengths with how often each is used."""
    left = histogram.copy()
    out = []
    present = np.flatnonzero(left)
    while len(present):
        room, pattern = capacity, []
        use: dict[int, int] = {}
        while True:
            at = np.searchsorted(present, room, side="right") - 1
            while at >= 0 and left[present[at]] <= use.get(int(present[at]), 0):
                at -= 1
            if at < 0:
                break
            length = int(present[at])
            use[length] = use.get(length, 0) + 1
            pattern.append(length)
            room -= length
        times = min(int(left[length]) // n for length, n in use.items())
        for length, n in use.items():
            left[length] -= n * times
        out.append((tuple(pattern), times))
        present = present[left[present] > 0]
    return out


def patterns(histogram: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Sets of at most four lengths that fill a sequence as far as the lengths at hand allow."""
    have = np.flatnonzero(histogram)
    found = {(int(x),) for x in have}

    def filled(pattern: list[int], room: int) -> None:
        at = np.searchsorted(have, room, side="right") - 1
        if at >= 0:
            found.add(tuple(sorted([*pattern, int(have[at])], reverse=True)))

    if not len(have):
        return []
    quantiles = np.unique(have[np.linspace(0, len(have) - 1, min(len(have), 24)).astype(int)])
    for a in have.tolist():
        filled([a], capacity - a)
        for b in quantiles.tolist():
            if a + b < capacity:
                filled([a, b], capacity - a - b)
            for c in quantiles[::6].tolist():
                if a + b + c < capacity:
                    filled([a, b, c], capacity - a - b - c)
    return sorted(found)


def least_squares(chosen: list[tuple[int, ...]], histogram: np.ndarray, steps: int) -> np.ndarray:
    """Repeat counts x >= 0 for which the patterns' lengths come nearest to the histogram.

    Accelerated projected gradient; a row is weighted by the inverse of its count, so that rare lengths
    are met as well as common ones, and a wasteful pattern costs what it leaves empty.
    """
    width = max(map(len, chosen))
    table = np.zeros((len(chosen), width), dtype=np.int64)
    for i, pattern in enumerate(chosen):
        table[i, : len(pattern)] = pattern
    used = (table > 0).astype(np.float64)
    scale = np.zeros(len(histogram))
    scale[histogram > 0] = 1 / np.sqrt(histogram[histogram > 0])
    empty = 1 - table.sum(1) / max(1, len(histogram) - 1)

    def forward(x):
        return np.bincount(table.ravel(), (x[:, None] * used).ravel(), len(histogram)) * scale

    def backward(r):
        return ((r * scale)[table] * used).sum(1)

    target = histogram * scale
    probe = np.ones(len(chosen))
    for _ in range(30):
        probe = backward(forward(probe))
        step = np.linalg.norm(probe)
        probe /= step
    x = y = np.zeros(len(chosen))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - (backward(forward(y) - target) + 0.05 * empty) / (1.05 * step))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(histogram: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with whole repeat counts that use every length exactly as often as the histogram says."""
    left = histogram.copy()
    out = []
    full = int(left[capacity])
    if full:
        out.append(((capacity,), full))
        left[capacity] = 0
    chosen = patterns(left, capacity)
    if chosen:
        times = np.floor(least_squares(chosen, left, steps) + 1e-9).astype(np.int64)
        # the fullest patterns first; none may use more of a length than there is
        for i in sorted(np.flatnonzero(times), key=lambda i: -sum(chosen[i])):
            if sum(chosen[i]) < 0.98 * capacity:
                break
            need = np.bincount(chosen[i], minlength=len(left))
            fits = need > 0
            repeat = int(min(times[i], (left[fits] // need[fits]).min()))
            if repeat:
                left -= repeat * need
                out.append((chosen[i], repeat))
    return out + best_fit(left, capacity)


def places(planned: list[tuple[tuple[int, ...], int]], capacity: int, sequence: int = 0) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first number, first sequence and offset of every range of its places; sequences count on from ``sequence``."""
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    taken = np.zeros(capacity + 1, dtype=np.int64)
    for pattern, times in planned:
        offset = 0
        for length in pattern:
            ranges.setdefault(length, []).append((int(taken[length]), sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for length, r in ranges.items()}


def _placed(where: dict[str, dict[int, tuple[np.ndarray, ...]]]):
    def run(batches):
        for batch in batches:
            sequence = np.zeros(len(batch), dtype=np.int64)
            offset = np.zeros(len(batch), dtype=np.int64)
            number = batch["number"].to_numpy()
            for (part, one), mine in batch.groupby(["part", "length"]).indices.items():
                first, at, shift = where[part][int(one)]
                of = np.searchsorted(first, number[mine], side="right") - 1
                sequence[mine] = at[of] + number[mine] - first[of]
                offset[mine] = shift[of]
            yield batch.drop(columns=["part", "number"]).assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = True, steps: int = STEPS, by: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, asked for, ids.

    A document is its text's ids and then id 0. Documents longer than ``capacity`` are cut into pieces of
    that many, the first of which may be shorter. Sequences hold ``capacity`` ids at most, without gaps.

    ``by`` names a column, of which documents of one sequence have the same value (nulls are one value).
    The driver plans for each value in turn, from one histogram, so there should be few: languages, not hosts.

    A null text counts as empty, so it is one piece with id 0 alone; null and repeated ids are carried
    along; an empty table gives an empty result; other columns are not looked at.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ranks = None if tokenizer else public_tokenizers.path("byte_bpe_50k.tiktoken")
    work = Workspace(spark, "packed")
    kinds = f"{ROW} long, part string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = numbered(docs, work)
    part = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")) if by else F.lit("")
    rows = docs.select(ROW, part.alias("part"), F.col("text").cast("string").alias("text"))
    cuts = rows.mapInPandas(_pieces(path, ranks, capacity, with_ids), kinds)
    named = work.write(cuts.withColumn("deal", F.pmod(F.xxhash64(ROW, "piece"), F.lit(DEALS)).cast("int")))

    # at most ``capacity`` rows of a part
    counts: dict[str, np.ndarray] = {}
    for r in named.groupBy("part", "length").count().collect():
        counts.setdefault(r["part"], np.zeros(capacity + 1, dtype=np.int64))[r["length"]] = r["count"]
    where, begun = {}, 0
    for name in sorted(counts):
        planned = plan(counts[name], capacity, steps)
        where[name] = places(planned, capacity, begun)
        begun += sum(times for _, times in planned)

    # numbers among the pieces of a length: where a deal begins, and the place in it
    deals = named.groupBy("part", "length", "deal").count()
    earlier = Window.partitionBy("part", "length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    begins = deals.withColumn("begin", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part", "length", "deal").orderBy(ROW, "piece")) - 1
    keys = named.drop("ids").withColumn("inside", inside).join(begins.select("part", "length", "deal", "begin"), ["part", "length", "deal"])
    numbers = keys.select(ROW, "part", "piece", "start", "length", "ids_crc32", (F.col("begin") + F.col("inside")).alias("number"))
    put = numbers.mapInPandas(_placed(where), f"{ROW} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    out = docs.select(ROW, "doc_id").join(put, ROW)
    if with_ids:
        out = out.join(named.select(ROW, "piece", "ids"), [ROW, "piece"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
