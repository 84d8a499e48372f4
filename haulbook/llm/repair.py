"""Repair of conversation structure by iterative-deepening A*.

A conversation is in order if the first letters of its roles read `(s?(ua)+)?`. `cheapest` finds
the edits of least cost that put it in order: Keep, Rerole to the role that is due, Delete, and
Insert an empty turn of that role. The search goes depth first through the edits in ASCII order of
their initials, under a bound on the cost that grows to the least cost the last search ran
beyond. A table holds, for every row and state of the pattern, a lower bound on what is still to
pay: at first an estimate (rows that must go, and neighbours that cannot both stay as they are),
later what failed searches proved. It outlasts the bounds, so no state fails twice for the same
reason. The first accepted path under the least bound is the answer, and of equally cheap ones
the first in ASCII order.

`audits` and `repaired` read conversations as streams of sorted partitions: rows are dealt by
conversation, sorted by Spark, which spills, and pass a task one after the other. The search
holds a few bytes a row, and the digest of a row's role and text; texts are never gathered. The
second pass has a conversation's audit in front of its rows.

Defined cases. A null role or text is one space, in `damage` also a null conv_id or turn as part
of the drawn number; rows are sorted by turn (nulls first), then role, then text, so ties are
settled; repeated rows are turns of their own, the later ones duplicates; a null conv_id is a
conversation; a role that is empty or begins otherwise fits nowhere; a conversation without
rows left has an empty audit; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import arrow_map

# What edits cost.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\v\f\r"
STOPS = ".!?"
#: Faults of a row, the first that holds.
SOUND, BLANK, DUPLICATE, UNFINISHED = range(4)

# States of the pattern: nothing yet, after s, after u, after a. Every state has one role due.
DUE = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
ENDS = (0, 3)
TO_END = (0, INSERT * 2, INSERT, 0)
LEGAL = ("su", "ua", "au")


def _step(state: int, initial: str) -> int | None:
    """The state after keeping a row."""
    if initial == "s" and state == 0:
        return 1
    return AFTER[state] if initial and initial == DUE[state][0] else None


def estimates(initials: Sequence[str], faults: Sequence[int]) -> list[list[int]]:
    """By state and row, a cost that the rows from there on cannot go below.

    Rows that have to be deleted or changed pay for that. Of two neighbours that are not legal
    side by side one more edit has to be paid; pairs that share no row add up.
    """
    out = []
    for known in ("sua", "ua"):  # a system row may stay only as the first
        paid, pairs, later = [0], [(0, 0)], None
        for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
            cut = fault == UNFINISHED
            if fault in (BLANK, DUPLICATE):
                paid.append(paid[-1] + DELETE)
                pairs.append(pairs[-1])
                continue
            stays = initial != "" and initial in known
            least = TRUNCATED * cut if stays else min(REROLE + TRUNCATED * cut, DELETE)
            paid.append(paid[-1] + least)
            weight = 0
            if later and stays and later[1] and initial + later[0] not in LEGAL:
                weight = DELETE - TRUNCATED if cut or later[2] else INSERT
            # Best sum of pairs from this row on, and from the row behind it.
            pairs.append((max(pairs[-1][0], weight + pairs[-1][1]), pairs[-1][0]))
            later = (initial, stays, cut)
        out.append([a + b for a, (b, _) in zip(paid, pairs, strict=True)][::-1])
    bounds = [list(out[0]), list(out[1]), list(out[1]), list(out[1])]
    for state in range(4):
        bounds[state][-1] = TO_END[state]
    return bounds


def cheapest(initials: Sequence[str], faults: Sequence[int]) -> tuple[int, str]:
    """Least cost and the edits' initials."""
    n, least = len(initials), estimates(initials, faults)

    def edits(row: int, state: int) -> list[tuple[str, int, int, int]]:
        """Initial, cost, next row and state; in ASCII order."""
        if row == n:
            return [("I", INSERT, row, AFTER[state])]
        out = [("D", DELETE, row + 1, state), ("I", INSERT, row, AFTER[state])]
        if faults[row] not in (BLANK, DUPLICATE):
            more = TRUNCATED * (faults[row] == UNFINISHED)
            if (kept := _step(state, initials[row])) is not None:
                out.append(("K", more, row + 1, kept))
            out.append(("R", REROLE + more, row + 1, AFTER[state]))
        return out

    while True:
        bound = least[0][0]
        # A frame: row, state, what may still be paid, the edits with the next one's number.
        stack, path = [[0, 0, bound, edits(0, 0), 0]], []
        while stack:
            row, state, budget, ways, at = frame = stack[-1]
            if row == n and state in ENDS:
                return bound - budget, "".join(path)
            if at == len(ways):
                least[state][row] = max(least[state][row], min(c + least[s][r] for _, c, r, s in ways))
                stack.pop()
                if path:
                    path.pop()
                continue
            frame[4] += 1
            initial, cost, r, s = ways[at]
            if least[s][r] <= budget - cost:
                path.append(initial)
                stack.append([r, s, budget - cost, edits(r, s), 0])


def replay(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of the turns that the edits leave of the rows (role, text)."""
    rows, state = iter(rows), 0
    for edit in audit:
        role, text = (DUE[state], "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "R":
            role = DUE[state]
        state = _step(state, role[:1])
        yield edit, role, text


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(" "))


def plain(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the texts, as rows that are `there`."""
    return chats.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"),
        F.lit(True).alias("there"),
    )


def damage(chats: DataFrame) -> DataFrame:
    """Rows with known damage, by crc32(`conv_id:turn`) mod 20: 0 takes the row away (it stays
    as a row that is not `there`), 1 empties the text, 2 takes its `.!?`, 3 repeats the row, 4
    makes it a user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")])
    drawn = F.crc32(key.cast("binary")) % 20
    rows = plain(chats).select("*", drawn.alias("drawn"))
    text = F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("drawn") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("drawn") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), (F.col("drawn") != 0).alias("there"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _streamed(rows: DataFrame, *order: str) -> DataFrame:
    """Dealt by conversation, each one's rows in order. The number of partitions is given, as
    the rows the tasks see are small but the search is not."""
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    return dealt.sortWithinPartitions("conv_id", *order)


def _conversations(batches, columns: Sequence[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows one by one); read the rows before the next conversation."""
    flat = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in columns), strict=True))
    yield from itertools.groupby(flat, key=lambda row: row[0])


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of `plain` or `damage`: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit."""
    bare = F.rtrim("text", F.lit(BLANKS))
    cases = F.when(bare == "", BLANK).when(F.instr(F.lit(STOPS), F.substr(bare, F.length(bare))) > 0, SOUND).otherwise(UNFINISHED)
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256))
    columns = ("conv_id", "turn", "there", "initial", "fault", "digest")
    coded = _streamed(rows, "turn", "role", "text").select(
        "conv_id", "turn", "there", F.substring("role", 1, 1).alias("initial"), cases.alias("fault"), digest.alias("digest"),
    )

    def work(batches):
        for conv, turns in _conversations(batches, columns):
            initials, faults, numbers, seen, illegal = [], [], set(), set(), 0
            for _, turn, there, initial, fault, digest in turns:
                if not there:
                    continue
                if turn is not None:
                    numbers.add(turn)
                if initials and initials[-1] + initial not in LEGAL:
                    illegal += 1
                initials.append(initial)
                faults.append(fault if fault == BLANK or digest not in seen else DUPLICATE)
                seen.add(digest)
            cost, audit = cheapest(initials, faults)
            gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            counts = (gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, UNFINISHED)), illegal, cost)
            yield {"conv_id": [conv], "audit": [audit]} | {n: [c] for n, c in zip(COUNTS, counts, strict=True)}

    kind = rows.schema["conv_id"].dataType.simpleString()
    return arrow_map(coded, _packed(work), f"conv_id {kind}, {', '.join(f'{n} long' for n in COUNTS)}, audit string")


def _audited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit in front of its rows, in one stream."""
    there = rows.where("there").select("conv_id", "turn", "role", "text", F.lit(None).cast(found.drop("conv_id").schema).alias("found"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    first = found.select("conv_id", *nothing, F.struct(*found.drop("conv_id").columns).alias("found"))
    return _streamed(first.union(there).withColumn("later", F.col("found").isNull()), "later", "turn", "role", "text").drop("later", "turn")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, nth (from 0), edit (K, R or I), role, text."""

    def work(batches):
        for conv, turns in _conversations(batches, ("conv_id", "role", "text", "found")):
            audit = next(turns)[3]["audit"]
            for nth, (edit, role, text) in enumerate(replay(audit, (t[1:3] for t in turns))):
                yield {"conv_id": [conv], "nth": [nth], "edit": [edit], "role": [role], "text": [text]}

    kind = rows.schema["conv_id"].dataType.simpleString()
    return arrow_map(_audited(rows, found), _packed(work), f"conv_id {kind}, nth long, edit string, role string, text string")


def _packed(work):
    """Joins the columns of single rows, by a thousand."""

    def run(batches):
        held, n = {}, 0
        for row in work(batches):
            for name, values in row.items():
                held.setdefault(name, []).extend(values)
            n += 1
            if n % 1000 == 0:
                yield held
                held = {}
        if held:
            yield held

    return run


def digests(chats: DataFrame) -> DataFrame:
    """The damaged conversations, repaired: the columns of `audits` and repaired_sha256, of
    `role:text` joined by newlines."""
    rows = damage(chats)
    found = audits(rows)

    def work(batches):
        for conv, turns in _conversations(batches, ("conv_id", "role", "text", "found")):
            row, sha = next(turns)[3], hashlib.sha256()
            for nth, (_, role, text) in enumerate(replay(row["audit"], (t[1:3] for t in turns))):
                sha.update(f"{chr(10) if nth else ''}{role}:{text}".encode())
            yield {"conv_id": [conv], "repaired_sha256": [sha.hexdigest()]} | {n: [v] for n, v in row.items()}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return arrow_map(_audited(rows, found), _packed(work), f"{schema}, repaired_sha256 string")
