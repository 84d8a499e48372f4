"""Repaired conversations against the cheapest path found by plain search, and SQL."""

import hashlib
import heapq
import random
import time
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haulbook.llm import oracles, repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DUE = (2, 2, 3, 2)


def plain_search(initials, faults):
    """Uniform-cost search; equal costs in the order of the audits."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(initials) and s in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, DUE[s]))
        if i < len(initials):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s))
            if faults[i] in (0, 3):
                if (s, initials[i]) in NEXT:
                    heapq.heappush(heap, (cost + faults[i], audit + "K", i + 1, NEXT[s, initials[i]]))
                heapq.heappush(heap, (cost + 3 + faults[i], audit + "R", i + 1, DUE[s]))


ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "u", "a", "a", "t", " ", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=14)


@settings(max_examples=1500, deadline=None)
@given(ROWS)
def test_cheapest(rows):
    initials, faults = [r[0] for r in rows], [r[1] for r in rows]
    want = plain_search(initials, faults)
    assert repair.cheapest(initials, faults) == want
    assert repair.estimates(initials, faults)[0][0] <= want[0]


def test_long_conversation():
    draw, begun = random.Random(5), time.time()
    initials, faults = [], []
    for i in range(20_000):
        hit = draw.randrange(20)
        initials.append("u" if hit == 4 else "ua"[i % 2])
        faults.append({1: 1, 2: 3, 3: 2}.get(hit, 0))
    assert repair.cheapest(initials, faults) == plain_search(initials, faults)
    assert time.time() - begun < 60


def answer(rows):
    """The columns of `digests` for one conversation's given rows."""
    kept = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text, hit = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if hit:
            text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
            kept += [(turn, "user" if hit == 4 else role, text)] * (1 + (hit == 3))
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    initials, faults = [r[1][:1] for r in kept], []
    for i, (_, role, text) in enumerate(kept):
        bare = text.strip(" \t\n\v\f\r")
        faults.append(1 if not bare else 2 if (role, text) in {r[1:] for r in kept[:i]} else 0 if bare[-1] in ".!?" else 3)
    cost, audit = plain_search(initials, faults)
    out, state, i = [], 0, 0
    for edit in audit:
        role = ("user", "user", "assistant", "user")[state]
        if edit in "KR":
            out.append((kept[i][1] if edit == "K" else role) + ":" + kept[i][2])
        elif edit == "I":
            out.append(role + ":")
        i += edit != "I"
        if edit != "D":
            state = NEXT[state, kept[i - 1][1][:1]] if edit == "K" else DUE[state]
    turns = {r[0] for r in kept} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (rows[0][0], gaps, *(faults.count(n) for n in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations():
    draw, rows = random.Random(9), []
    texts = ["Yes.", "No!", "Why?", "", None, " \t\n", "cut of", "ends. \n", "ü?", " ", "a.b", "é" * 3000 + "."]
    for conv in [None, *range(120)]:
        for _ in range(draw.randrange(1, 12)):
            turn = draw.choice([None, *range(8)])
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "user", "assistant", None, "", "Tool"]), draw.choice(texts)))
    gone = next(i for i in range(1000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "Hi.")] + rows[:3], gone


@pytest.fixture(scope="module")
def planted(spark):
    rows, gone = conversations()
    extra = {n: "extra" for n in ("edit", "audit", "there", "n", "found", "later")}
    from pyspark.sql import functions as F

    return rows, gone, spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(v) for n, v in extra.items()})


def test_planted_rows(planted):
    rows, gone, df = planted
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    got = sorted((tuple(r) for r in repair.digests(df).collect()), key=repr)
    assert got == sorted(map(answer, by.values()), key=repr)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_planted_rows_in_sql(planted):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", planted[0])
    assert sorted(con.execute(oracles.OP12).fetchall(), key=repr) == sorted((tuple(r) for r in repair.digests(planted[2]).collect()), key=repr)


def test_repaired_rows_are_in_order(planted):
    rows = repair.damage(planted[2])
    out = {}
    for r in repair.repaired(rows, repair.audits(rows)).collect():
        out.setdefault(r.conv_id, []).append((r.nth, r.role))
    import re

    for turns in out.values():
        assert [n for n, _ in sorted(turns)] == list(range(len(turns)))
        assert re.fullmatch("s?(ua)+", "".join(role[0] for _, role in sorted(turns)))


def test_empty(spark):
    assert repair.digests(spark.createDataFrame([], SCHEMA)).collect() == []
