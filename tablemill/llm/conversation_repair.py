"""Conversations put into legal order at the least cost, by depth-first branch and bound.

A legal conversation is empty or has role initials ``s?(ua)+``. A row can be kept, given the role user or
assistant, or deleted, and rows without text can be inserted. What a search has to know of a row is one
letter, so a conversation is a short string and equal strings are searched once.

A search walks rows from first to last with an explicit stack. A node is a row's place and the initial
written last; its dominance table holds the best (cost, audit) that has reached it, and a prefix that is
not better ends there. Suffix bounds say what the rows ahead cost at least. With them and the best whole
repair so far (the incumbent), a prefix that cannot win is cut off; when the stack is empty, the incumbent
is proved best. All prefixes of a node end with the letter of the same row, so none begins another of equal
cost, and the better prefix stays better whatever follows.

A long conversation is searched window by window: the dominance table at a window's end, four nodes at
most, is all that has to be carried on, so nothing is lost by it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.store import Workspace

BLANKS = " \t\n\x0b\x0c\r"
WINDOW_ROWS = 48
WINDOW_CHARS = 1 << 22
RETAG, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)  # initial written last
LEGAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# -- one search -----------------------------------------------------------------------------------


def _inserts(state: int, limit: int = 2) -> Iterator[tuple[str, int]]:
    """Rows inserted after ``state``, none to ``limit`` of them, and the state then."""
    written = ""
    yield written, state
    for _ in range(limit):
        state = LEGAL.get((state, "u")) or LEGAL[state, "a"]
        written += "I"
        yield written, state


def _edges(kind: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, letters, next state) of what can be done up to and with a row, the best first.

    ``kind`` is ``D`` for a row that must go, else its initial, ``-`` for one that is never legal; ``S``, ``U``,
    ``A`` and ``_`` are the same with a truncated text.
    """
    out = []
    for written, at in _inserts(state):
        cost = INSERT * len(written)
        out.append((cost + DELETE, f"{written}D", at))
        if kind == "D":
            continue
        stays = cost + TRUNCATED * (kind in "SUA_")
        for initial in "sua":
            if (at, initial) in LEGAL:
                if initial == kind.lower():
                    out.append((stays, f"{written}K", LEGAL[at, initial]))
                elif initial in ROLES:
                    out.append((stays + RETAG, f"{written}R", LEGAL[at, initial]))
    return sorted(out)


EDGES = {(kind, state): _edges(kind, state) for kind in "DsuaSUA-_" for state in range(4)}
SPARE = {"s": RETAG, "S": DELETE - TRUNCATED}  # what a system row costs less where it may stand
CLOSING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


def floors(kinds: str) -> list[int]:
    """For each place, a cost that no repair of the rows from there on can undercut, once something is written.

    A row that must go, is truncated or has no place after the first costs something by itself; of two rows
    side by side with one initial, one is changed or a row comes between them. Pairs do not overlap.
    """
    single = {"D": DELETE, "s": RETAG, "-": RETAG, "u": 0, "a": 0, "U": TRUNCATED, "A": TRUNCATED, "S": DELETE, "_": DELETE}
    out = [0] * (len(kinds) + 1)
    after = (len(kinds), "")  # the next row that may stay
    for i in range(len(kinds) - 1, -1, -1):
        out[i] = single[kinds[i]] + out[i + 1]
        if kinds[i] == "D":
            continue
        at, kind = after
        if kind == kinds[i] and kind in "ua":
            between = sum(single[k] for k in kinds[i + 1 : at])
            out[i] = max(out[i], between + INSERT + out[at + 1])
        after = (i, kinds[i])
    return out


@functools.lru_cache(maxsize=1 << 16)
def search(kinds: str, start: int = START, closing: bool = True) -> dict[int, tuple[int, str]]:
    """Best (cost, audit) of repairing ``kinds`` after ``start``, by state at the end.

    With ``closing`` there is one end, a legal conversation, under ``START``.
    """
    n = len(kinds)
    ahead = floors(kinds)
    # the first system row may stand free where nothing has been written yet
    spare = list(itertools.accumulate((SPARE.get(k, 0) for k in reversed(kinds)), max, initial=0))[::-1]
    tables: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    tables[0][start] = (0, "")
    incumbent: tuple[int, str] | None = None
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if tables[i][state] != (cost, audit):
            continue  # a better prefix came since
        if i == n:
            if closing:
                more, letters = CLOSING[state]
                whole = (cost + more, audit + letters)
                incumbent = whole if incumbent is None else min(incumbent, whole)
            continue
        if incumbent:
            least = cost + ahead[i] - (spare[i] if state == START else 0)
            if (least, audit) > (incumbent[0], incumbent[1][: len(audit)]):
                continue
        for c, letters, then in reversed(EDGES[kinds[i], state]):
            new = (cost + c, audit + letters)
            table = tables[i + 1]
            if then not in table or new < table[then]:
                table[then] = new
                stack.append((i + 1, then, *new))
    return {START: incumbent} if closing else tables[n]


def written(audit: str) -> Iterator[tuple[str, str | None]]:
    """Each edit with the role it gives, which only R and I do; a system row leads iff the result's length is odd."""
    place = sum(letter != "D" for letter in audit) % 2  # user rows have even places from here on
    for letter in audit:
        yield letter, ROLES["a" if place % 2 else "u"] if letter in "RI" else None
        place += letter != "D"


# -- one conversation -----------------------------------------------------------------------------


class _Case:
    """A conversation under repair, row by row. Holds a window's rows and a hash for each state."""

    def __init__(self):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = None
        self.initial = ""
        self.kinds: list[str] = []
        self.rows: list[tuple[str, str]] = []
        self.held = 0
        # state: (cost, rank of the audit among the states, audit in pieces, hash, whether it has rows)
        self.front = {START: (0, 0, None, hashlib.sha256(), False)}

    def add(self, turn, role: str, text: str, copy: bool) -> None:
        if self.held >= WINDOW_CHARS or len(self.rows) >= WINDOW_ROWS:
            self.settle(False)
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1] or " "
        if self.n and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.n, self.initial = self.n + 1, initial
        bare = text.rstrip(BLANKS)
        kind = initial if initial in "sua" else "-"
        if not bare:
            self.blank, kind = self.blank + 1, "D"
        elif copy:
            self.duplicate, kind = self.duplicate + 1, "D"
        elif bare[-1] not in ".!?":
            self.truncated, kind = self.truncated + 1, kind.upper() if kind != "-" else "_"
        self.kinds.append(kind)
        self.rows.append((role, text))
        self.held += len(text)

    def settle(self, closing: bool) -> None:
        """Search the window from each state and carry the best of each end on."""
        kinds = "".join(self.kinds)
        ends: dict[int, tuple] = {}
        for state, (cost, rank, pieces, digest, some) in self.front.items():
            for end, (more, audit) in search(kinds, state, closing).items():
                ends[end] = min(ends.get(end, (float("inf"),)), (cost + more, rank, audit, state))
        order = {end: place for place, end in enumerate(sorted(ends, key=lambda e: ends[e][1:3]))}
        front = {}
        for end, (cost, _, audit, state) in ends.items():
            _, _, pieces, digest, some = self.front[state]
            digest = digest.copy()
            for line in self.lines(audit, state):
                digest.update(b"\n" * some + line)
                some = True
            front[end] = (cost, order[end], (pieces, audit), digest, some)
        self.front, self.kinds, self.rows, self.held = front, [], [], 0

    def lines(self, audit: str, state: int) -> Iterator[bytes]:
        rows = iter(self.rows)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(rows)
            if letter == "D":
                continue
            if letter != "K":
                role = ROLES["a" if state == USER else "u"]
            state = LEGAL[state, role[0]]
            yield f"{role}:{text}".encode()

    def report(self) -> tuple:
        self.settle(True)
        ((cost, _, pieces, digest, _),) = self.front.values()
        audit = []
        while pieces:
            pieces, piece = pieces
            audit.append(piece)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(reversed(audit)), digest.hexdigest()


# -- tables ---------------------------------------------------------------------------------------


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn``, nulls read as a space."""
    fault = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    rows = turns.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), fault.alias("fault"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_op_copy")).drop("_op_copy")


def _in_order(turns: DataFrame, first: DataFrame | None) -> DataFrame:
    """Rows of a conversation together and in order, behind ``first`` (conv_id, audit); copies are marked."""
    text, role = _spaced("text"), _spaced("role")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("_op_same", F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256))
    rows = rows.withColumn("_op_row", F.lit(True)).withColumn("_op_audit", F.lit(None).cast("string"))
    if first is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("_op_same", "string"))]
        rows = rows.unionByName(first.select("conv_id", *none, F.lit(False).alias("_op_row"), F.col("audit").alias("_op_audit")))
    seen = Window.partitionBy("conv_id", "_op_same").orderBy(F.asc_nulls_first("turn"))
    marked = rows.repartition("conv_id").withColumn("_op_again", F.row_number().over(seen) > 1)
    order = ["conv_id", "_op_row", F.asc_nulls_first("turn"), "role", "text", "_op_again"]
    return marked.sortWithinPartitions(*order).select("conv_id", "_op_row", "turn", "role", "text", "_op_again", "_op_audit")


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1_000):
            part = batch.slice(start, 1_000)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _arrow(schema: pa.Schema, rows: Iterator[tuple], some: int = 2_000, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as batches bounded in rows and in length."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= some or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def plan(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, the least cost of repair, the edits, and a hash of the result.

    ``turns`` has conv_id, turn, role and text; other columns are not looked at. Rows come by turn, nulls
    first; rows of one turn by role and text. ``every`` (conv_id) names conversations to report even if
    they have no row. gaps are turns missing between the first and the last (nulls do not count, at most
    2**63 - 1). A row's first fault counts: blank (white space only), duplicate (role and text seen earlier),
    truncated (last character no ``.``, ``!`` or ``?``). illegal counts neighbours whose initials are not
    su, ua or au. audit has a letter for each edit (Keep, Rerole, Delete, Insert); of equal costs the least
    string. repaired_sha256 is the hash of ``role:text`` of the repaired rows, joined by newlines.

    Null roles and texts are read as one space, so such a text is blank and such a role none that is legal, nor is an
    empty one; null conv_ids are one conversation. A conversation without rows has zeros, no edits and the hash of
    nothing. An empty table gives an empty one.

    A conversation passes through one task, as its hash must, but as a stream: held are a window of rows
    (``WINDOW_ROWS``, ``WINDOW_CHARS``) and the edits so far; Spark's sort spills.
    """
    if every is not None:
        every = every.select("conv_id").distinct().withColumn("audit", F.lit(None).cast("string"))
    rows = _in_order(turns, every)
    out = rows.limit(0).selectExpr("conv_id", *[f"cast(null as {c.split()[1]}) {c.split()[0]}" for c in REPORT.split(", ")]).schema

    def reports(rows):
        current, case = None, None
        for conv, real, turn, role, text, again, _ in rows:
            if case is None or conv != current:
                if case:
                    yield current, *case.report()
                current, case = conv, _Case()
            if real:
                case.add(turn, role, text, again)
        if case:
            yield current, *case.report()

    kinds = [(c.split()[0], pa.int64() if "long" in c else pa.string()) for c in REPORT.split(", ")]
    return rows.mapInArrow(_streamed(reports, kinds), out)


def repair(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I) and turn (null if inserted).

    Handles rows as :func:`plan` does; deleted rows are left out.
    """
    work = Workspace(turns.sparkSession, "repair")
    audits = work.write(plan(turns).select("conv_id", "audit"))
    rows = _in_order(turns, audits)
    out = rows.select("conv_id", F.lit(0).cast("long").alias("place"), "role", "text", F.lit("").alias("edit"), "turn").limit(0).schema

    def messages(batch):
        edits, at, last, place = [], 0, -1, 0
        for conv, real, turn, role, text, _, audit in batch:
            if not real:
                edits, at, last, place = list(written(audit)), 0, len(audit.rstrip("I")) - 1, 0
                continue
            while True:
                letter, given = edits[at]
                own = letter != "I"
                if letter != "D":
                    yield conv, place, given or role, text if own else "", letter, turn if own else None
                    place += 1
                at += 1
                # rows inserted after the last own row come with it
                if at == len(edits) or own and at <= last:
                    break

    kinds = [("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()), ("turn", pa.int64())]
    return rows.mapInArrow(_streamed(messages, kinds), out)


def _streamed(run, kinds: list[tuple]):
    """A function for ``mapInArrow``: ``run`` turns all rows of a task into tuples that begin with the conv_id."""

    def go(batches):
        first = next(batches, None)
        if first is not None:
            schema = pa.schema([first.schema.field(0), *(pa.field(*k) for k in kinds)])
            yield from _arrow(schema, run(_rows(itertools.chain([first], batches))))

    return go
