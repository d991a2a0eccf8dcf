import hashlib
import heapq
import random
import zlib

import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tablemill.llm import conversation_repair as cr
from tablemill.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, place string, audit string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """By uniform cost over (cost, audit): the first goal taken from the heap is the best."""
    goal, n = {"", "a"}, len(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == n and last in goal:
            return cost, audit, out
        if (i, last, audit[-1:] == "I") in done:
            continue
        done.add((i, last, audit[-1:] == "I"))

        def fits(initial, last=last):
            return (last + initial) in ("s", "u", "su", "ua", "au")

        for role in ("user", "assistant"):
            if fits(role[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*out, (role, ""))))
        if i < n:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if role and fits(role[0]):
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, (role, text))))
            for new in ("user", "assistant"):
                if fits(new[0]):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, new[0], (*out, (new, text))))


def by_hand(data, damage=True):
    conversations = {}
    for conv, turn, role, text in data:
        mine = conversations.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20 if damage else 19
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        mine.extend([(turn, role, text)] * (2 if fault == 3 else 1))
    out = {}
    for conv, mine in conversations.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        rows, seen = [], set()
        for _, role, text in mine:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            rows.append((role, text, fault))
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] or " " for r, *_ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, kept = cheapest(rows)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        counts = [sum(f == k for *_, f in rows) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, digest), kept
    return out


def odd_rows():
    draw = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user"], ["Yes.", "No!", "so", "", " \n", None, "Déjà vu?", "a "]
    rows = [(c, draw.choice([None, *range(9)]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"{i}.") for c in range(60) for i in range(draw.randint(1, 9))]
    rows += [(None, t, "user" if t % 2 else "assistant", f"{t}?") for t in range(6)] + [(None, None, None, None)]
    rows += [(99, 5, "user", "same.")] * 7 + [(98, -(2**63), "user", "x."), (98, 2**63 - 1, "assistant", "y.")]
    rows += [(97, t, draw.choice(["user", "assistant", "system", "x"]), f"{t}{draw.choice('.,')}") for t in range(300)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "a") for r in rows], SCHEMA)


@pytest.mark.parametrize("damage", [True, False])
@pytest.mark.parametrize("window", [48, 3])
def test_reports(spark, damage, window, monkeypatch):
    monkeypatch.setattr(cr, "WINDOW_ROWS", window)
    rows = odd_rows()
    given = frame(spark, rows)
    found = cr.plan(cr.damaged(given) if damage else given, every=given)
    wanted = {c: r for c, (r, _) in by_hand(rows, damage).items()}
    wanted[98] = (min(wanted[98][0], 2**63 - 1), *wanted[98][1:])
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == wanted


def test_windows_give_the_whole_search():
    draw = random.Random(1)
    for _ in range(300):
        kinds = "".join(draw.choice("DsuaSUA-_uaua") for _ in range(draw.randint(0, 14)))
        front = {cr.START: (0, "")}
        for i in range(0, max(1, len(kinds)), 3):
            ends = {}
            for state, (cost, audit) in front.items():
                for end, (more, letters) in cr.search(kinds[i : i + 3], state, i + 3 >= len(kinds)).items():
                    ends[end] = min(ends.get(end, (10**9, "")), (cost + more, audit + letters))
            front = ends
        assert front[cr.START] == cr.search(kinds)[cr.START]


def test_bounds_are_not_above_the_cost():
    draw = random.Random(2)
    for _ in range(300):
        kinds = "".join(draw.choice("DsuaSUA-_") for _ in range(draw.randint(0, 7)))
        for state in (cr.SYSTEM, cr.USER, cr.ASSISTANT):
            assert cr.floors(kinds)[0] <= cr.search(kinds, state)[cr.START][0]


def test_repaired_rows(spark):
    rows = odd_rows()
    found = {}
    for r in cr.repair(frame(spark, rows)).orderBy("conv_id", "place").collect():
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert r["place"] == len(found[r["conv_id"]]) - 1 and (r["edit"] == "I") <= (r["turn"] is None)
    assert found == {c: list(kept) for c, (_, kept) in by_hand(rows, False).items() if kept}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op11_conversation_repair(spark, DATA)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {c: r for c, (r, _) in by_hand(rows).items()}


def test_empty(spark):
    none = frame(spark, [])
    assert cr.plan(none).count() == 0 and cr.repair(none).count() == 0
    one = cr.plan(none, every=spark.range(1).select(F.col("id").alias("conv_id"))).first()
    assert tuple(one) == (0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
