"""Removal of long byte strings that occur more than once, over a sparse suffix array.

A string of ``length`` bytes is a suffix of its document cut off at that length. Sorting all
suffixes of a corpus needs several times its size, so only sampled ones travel. Every window of
``length`` bytes is put down to one anchor: the smallest ``SEED``-byte fingerprint that begins in its
first ``spread`` bytes (the leftmost of equals). The choice depends on the window's bytes alone, so
equal windows have their anchors at the same place, and share the ``length - spread + 1`` bytes from
there on, the anchor's core. One anchor serves a run of neighbouring windows, its chunk.

1. Anchors whose core occurs once stand for windows that occur once. They are counted and go.
2. Anchors with equal chunks repeat each other in every window. One chunk of each kind goes on.
3. Chunks that share a core but differ are dealt out by range of their leading bytes, with splitters
   sampled by Spark. Each bucket sorts its suffixes token by token, going on only inside runs that are
   equal so far (multikey quicksort), and leaves those that have an equal neighbour.
   Splitters fall between cores, so no equal suffixes lie on two sides of a boundary.
4. A core with more than ``crowd`` chunks would fill a bucket. Its suffixes are counted one by one in
   a grouped aggregate, which Spark combines before it shuffles.

Which windows repeat is decided on the input. Steps 3 and 4 compare 64-bit fingerprints of the tokens
together with the core's.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.bytehash import Hashes
from tablemill.llm.store import ROW, Workspace, lean, numbered, tasks, tidy

LENGTH = 400
SPREAD = 256
SEED = 24
CROWD = 4096
BLOCK = 1 << 18  # windows looked at together

_lean = functools.partial(lean, "repeats")


def anchors(data: bytes, length: int = LENGTH, spread: int = SPREAD) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor, first and last window, core and chunk fingerprint of each run of windows."""
    for begin in range(0, len(data) - length + 1, BLOCK):
        part = data[begin : begin + BLOCK + length - 1]
        hashes = Hashes(part)
        windows = len(part) - length + 1
        seeds = hashes.every(SEED)[: windows + spread - 1]
        bits = np.uint64(max(1, int(len(seeds) - 1).bit_length()))
        ranked = (seeds >> bits << bits) | np.arange(len(seeds), dtype=np.uint64)
        width = 1
        while width < spread:
            step = min(width, spread - width)
            ranked = np.minimum(ranked[:-step], ranked[step:])
            width += step
        best = (ranked[:windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        turn = np.flatnonzero(np.diff(best)) + 1
        first = np.concatenate(([0], turn))
        last = np.concatenate((turn, [windows])) - 1
        at = best[first]
        core = hashes.at(at, length - spread + 1)
        chunk = hashes.at(first, last - first + length)
        # windows of a chunk are equal only if they are the same ones around the anchor
        chunk ^= (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        yield at + begin, first + begin, last + begin, core.view(np.int64), chunk.view(np.int64)


def _anchor_rows(length: int, spread: int):
    def run(batches):
        for batch in batches:
            for row, text in zip(batch[ROW], batch["text"], strict=True):
                if text is None or len(text) * 4 < length:
                    continue
                data = text.encode()
                if len(data) < length:
                    continue
                for at, first, last, core, chunk in anchors(data, length, spread):
                    yield {ROW: np.full(len(at), row), "at": at, "before": (at - first).astype("int16"), "after": (last - at).astype("int16"), "core": core, "chunk": chunk}

    return run


def _gathered(run, rows: int = 20_000):
    """A few large frames from many dictionaries of short arrays."""

    def joined(held):
        return pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    def go(batches):
        held, n = [], 0
        for columns in run(batches):
            held.append(columns)
            n += len(columns[ROW])
            if n >= rows:
                yield joined(held)
                held, n = [], 0
        if held:
            yield joined(held)

    return go


def equal_neighbours(labels: np.ndarray, tokens: list[np.ndarray]) -> np.ndarray:
    """Which rows have another row with the same label and tokens.

    Multikey quicksort: rows are sorted by one token within the runs that are equal so far, and only
    runs of two rows or more look at the next token.
    """
    alive = np.arange(len(labels))
    for token in [np.zeros(len(labels), dtype=np.uint64), *tokens]:
        value = token[alive]
        order = np.lexsort((value, labels))
        label, value = labels[order], value[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (label[1:] != label[:-1]) | (value[1:] != value[:-1])
        run = np.cumsum(new) - 1
        stays = np.bincount(run, minlength=run[-1] + 1 if len(run) else 0)[run] > 1
        alive, labels = alive[order][stays], run[stays]
    found = np.zeros(len(tokens[0]), dtype=bool)
    found[alive] = True
    return found


def _chunk_rows(length: int):
    """The chunks asked for, cut out of their documents."""
    names = [ROW, "first", "before", "core", "crowded", "lead", "bytes"]

    def run(batches):
        for batch in batches:
            out = []
            for row, text, wanted in zip(batch[ROW], batch["text"], batch["wanted"], strict=True):
                data = text.encode()
                for w in wanted:
                    at, first, end = w["at"], w["at"] - w["before"], w["at"] + w["after"] + length
                    out.append((row, first, w["before"], w["core"], w["crowded"], data[at : at + 16], data[first:end]))
                    if len(out) == 5_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    return run


def _window_tokens(data: bytes, start: np.ndarray, length: int) -> list[np.ndarray]:
    hashes = Hashes(data)
    quarter = length // 4
    parts = [(0, quarter), (quarter, quarter), (2 * quarter, quarter), (3 * quarter, length - 3 * quarter)]
    return [hashes.at(start + skip, size) for skip, size in parts]


def _runs(frame: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows as runs of neighbouring first bytes."""
    frame = frame.sort_values([ROW, "start"])
    new = (frame[ROW].diff() != 0) | (frame["start"].diff() != 1)
    return frame.groupby(new.cumsum()).agg(**{ROW: (ROW, "first"), "first": ("start", "first"), "last": ("start", "last")})


def _sorted_bucket(length: int):
    """Sort the suffixes of whole cores; a core's chunks arrive one after the other."""

    def settle(chunks: pd.DataFrame) -> pd.DataFrame:
        sizes = chunks["bytes"].map(len).to_numpy()
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(chunks)), windows)
        inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(np.cumsum(sizes) - sizes, windows) + inside
        offset = chunks["before"].to_numpy()[owner] - inside
        group = pd.factorize(chunks["core"])[0][owner].astype(np.int64) * 2048 + offset + 1024
        tokens = _window_tokens(b"".join(chunks["bytes"]), start, length)
        found = equal_neighbours(group, tokens)
        return _runs(pd.DataFrame({ROW: chunks[ROW].to_numpy()[owner][found], "start": (chunks["first"].to_numpy()[owner] + inside)[found]}))

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            open_core = held["core"].iloc[-1]
            done = held["core"] != open_core  # sorted: the last core may go on
            if done.sum() >= 512:
                yield settle(held[done].reset_index(drop=True))
                held = held[~done]
        if held is not None and len(held):
            yield settle(held.reset_index(drop=True))

    return run


def _single_suffixes(length: int):
    def run(batches):
        for batch in batches:
            for row, first, before, core, data in zip(batch[ROW], batch["first"], batch["before"], batch["core"], batch["bytes"], strict=True):
                start = np.arange(len(data) - length + 1)
                whole = Hashes(data).at(start, length)
                yield {"core": np.full(len(start), core), "offset": (before - start).astype("int16"), "whole": whole.view(np.int64), ROW: np.full(len(start), row), "first": first + start}

    return run


def repeated_windows(docs: DataFrame, work: Workspace, length: int, spread: int, crowd: int) -> DataFrame:
    """Runs of windows (first and last start) that occur elsewhere, by row of numbered ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(ROW, F.col("text").cast("string").alias("text"))
    found = work.write(rows.mapInPandas(_lean(_gathered(_anchor_rows(length, spread))), f"{ROW} long, at long, before short, after short, core long, chunk long"))

    shared = found.groupBy("core").agg(F.count("*").alias("n"), F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("n > 1")
    # written, so that the files of its shuffle are gone before all anchors are shuffled
    shared = work.write(shared.select("core", (F.col("low") != F.col("high")).alias("mixed")))
    tidy(spark)
    kept = work.write(found.join(shared, "core"))
    work.drop(found, shared)

    # one chunk of each kind stands for the others of its kind
    own = F.struct(ROW, "at", "before", "after")
    kinds = work.write(kept.where("mixed").groupBy("core", "chunk").agg(F.count("*").alias("copies"), F.min(own).alias("one")))
    crowds = kinds.groupBy("core").count().where(F.col("count") > crowd).select("core", F.lit(True).alias("crowded"))
    asked = kinds.join(crowds, "core", "left").select("one.*", "core", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    wanted = asked.groupBy(ROW).agg(F.collect_list(F.struct("at", "before", "after", "core", "crowded")).alias("wanted"))
    cut = rows.join(wanted, ROW).mapInPandas(_lean(_chunk_rows(length)), f"{ROW} long, first long, before short, core long, crowded boolean, lead binary, bytes binary")
    chunks = work.write(cut)

    buckets = chunks.where("not crowded").repartitionByRange(tasks(spark), "lead", "core").sortWithinPartitions("lead", "core")
    local = buckets.drop("lead", "crowded").mapInPandas(_lean(_sorted_bucket(length)), f"{ROW} long, first long, last long")

    key = ["core", "offset", "whole"]
    singles = work.write(chunks.where("crowded").mapInPandas(_lean(_gathered(_single_suffixes(length))), f"core long, offset short, whole long, {ROW} long, first long"))
    again = singles.join(singles.groupBy(*key).count().where("count > 1"), key, "left_semi").select(ROW, "first", F.col("first").alias("last"))

    run = [ROW, (F.col("at") - F.col("before")).alias("first"), (F.col("at") + F.col("after")).alias("last")]
    alike = kept.where("mixed").join(kinds.where("copies > 1").select("core", "chunk"), ["core", "chunk"], "left_semi")
    return kept.where("not mixed").select(*run).unionByName(alike.select(*run)).unionByName(local).unionByName(again)


def _merged(spans, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes, as starts and ends."""
    if spans is None or len(spans) == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    start = np.array([s["first"] for s in spans], dtype=np.int64)
    end = np.array([s["last"] for s in spans], dtype=np.int64) + length
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def _cut(length: int, with_text: bool):
    names = [ROW, *(f"_op_{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text))]

    def run(batches):
        for batch in batches:
            out = []
            for row, text, spans in zip(batch[ROW], batch["text"], batch["spans"], strict=True):
                data = (text or "").encode()
                start, end = _merged(spans, length)
                edges = np.concatenate(([0], np.column_stack((start, end)).ravel(), [len(data)]))
                rest = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                made = (row, len(data), int((end - start).sum()), len(start), hashlib.sha256(rest).hexdigest())
                out.append((*made, rest.decode(errors="ignore")) if with_text else made)
                if len(out) == 500:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, spread: int = SPREAD, crowd: int = CROWD, with_text: bool = True) -> DataFrame:
    """Cut every byte covered by a ``length``-byte string that also starts anywhere else.

    Adds n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes) and,
    with ``with_text``, replaces text by what remains, without characters that lost some of their
    bytes. Strings never cross documents; strings of one document count as well. Every row stays.

    A null text counts as empty and stays null unless something is cut; texts shorter than ``length``
    bytes are left alone; rows that are equal in all columns are copies of each other like any others;
    an empty table gives an empty one. Other columns are carried along. Columns
    of the names added are replaced; names that begin with ``_op_`` are the operator's own.
    """
    if not 0 < spread + SEED <= length:
        raise ValueError("spread + SEED must not exceed length")
    spark = docs.sparkSession
    work = Workspace(spark, "repeats")
    docs = numbered(docs, work)
    passing = Workspace(spark, "windows")
    spans = repeated_windows(docs, passing, length, spread, crowd)
    lists = work.write(spans.groupBy(ROW).agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    # only the lists are read again: what led to them, shuffle files too, goes before texts are shuffled
    del spans
    passing.release()
    rows = docs.select(ROW, F.col("text").cast("string").alias("text"))
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [f"{ROW} long", *(f"_op_{c} {'string' if c == 'kept_sha256' else 'long'}" for c in made), *["_op_kept string"] * with_text]
    cut = rows.join(lists, ROW).mapInPandas(_lean(_cut(length, with_text)), ", ".join(kinds))
    same = [c for c in docs.columns if c not in (ROW, *made) and (with_text or c != "text")]
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    left = docs.select(ROW, *same, F.octet_length(data).cast("long").alias("_op_all"), F.sha2(data, 256).alias("_op_sha"))
    out = left.join(cut, ROW, "left")
    otherwise = {"n_bytes": F.col("_op_all"), "n_removed": F.lit(0), "n_spans": F.lit(0), "kept_sha256": F.col("_op_sha")}
    kept = [F.coalesce("_op_kept", "text").alias("text") if c == "text" else F.col(c) for c in same]
    return out.select(*kept, *[F.coalesce(f"_op_{c}", otherwise[c]).alias(c) for c in made])
