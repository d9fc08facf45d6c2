"""Repair of conversation structure by cheapest edits, streamed with a secondary sort.

Rows are dealt by conversation and sorted by turn, last turn first. `mapInPandas` carries the state
of a dynamic program across Arrow batches: for each of four states of the grammar
`(s?(ua)+)?` over role initials, what the rest of the conversation costs from there. For each row it
keeps one byte, the best edit from each state; rows and bytes of a conversation beyond SPILL_BYTES
go to a file of the task. When the first turn is reached the edits are read off forwards, and the
rows come out in order. So a conversation of any length takes a bounded amount of memory.

Edits: K keeps a row (0), R gives it the role user or assistant (1), D deletes it (2), I inserts an
empty user or assistant row (5). Blank and duplicate rows have to go; truncated rows that stay add 5.
Of edits that cost the same, the ones whose initials come first in ASCII order are taken; initials
and start state fix every edit, so a choice row by row gives that order.

Defined cases: null role and text count as one space, null turns come first, a null conversation is
one of its own; equal turns are ordered by role and text; a role whose initial is none of s, u, a
can't be kept; an empty table gives an empty result. Other columns of the caller are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPILL_BYTES = 32 << 20
OUT_BYTES = 8 << 20
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = (None, "blank", "duplicate", "truncated")
ROW = (
    "conv_id string, place long, edit string, role string, text string, turn long, old_role string, fault string"
)
DIGEST = (
    "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
#: States: nothing yet, after the system row, after a user row, after an assistant row.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
LEGAL = {"su", "ua", "au"}
INITIALS = "sua"
CHARS = "DIKR"
#: Cost from each state when no row is left, and the edits there.
END_COST = (0, 2 * INSERT, INSERT, 0)
END_STOPS = (True, False, False, True)

_steps: dict[tuple, tuple] = {}


def step(cost: tuple, initial: str, fault: int) -> tuple[tuple, int]:
    """Costs before a row from the costs after it, and the best edit of each state, two bits each."""
    key = (cost, initial, fault)
    if key in _steps:
        return _steps[key]
    own = []
    for s in range(4):
        ways = [(DELETE + cost[s], "D")]
        if fault not in (1, 2):
            extra = BROKEN if fault == 3 else 0
            ways.append((REROLE + extra + cost[NEXT[s]], "R"))
            if initial in AFTER[s]:
                ways.append((KEEP + extra + cost[AFTER[s][initial]], "K"))
        own.append(min(ways))
    two = min(own[2], (INSERT + own[3][0], "I"))
    three = min(own[3], (INSERT + own[2][0], "I"))
    best = [min(own[0], (INSERT + two[0], "I")), min(own[1], (INSERT + two[0], "I")), two, three]
    edits = sum(CHARS.index(c) << 2 * s for s, (_, c) in enumerate(best))
    _steps[key] = tuple(v for v, _ in best), edits
    return _steps[key]


class Backlog:
    """Rows of one conversation with their edit bytes, last turn first; read back first turn first."""

    def __init__(self, spill_bytes: int):
        self.rows, self.edits, self.held, self.spilled = [], bytearray(), 0, []
        self.file, self.spill_bytes = None, spill_bytes

    def push(self, row: tuple, edits: int) -> None:
        self.rows.append(row)
        self.edits.append(edits)
        self.held += 200 + len(row[2])
        if self.held >= self.spill_bytes:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.spilled.append(self.file.tell())
            pickle.dump((self.rows, bytes(self.edits)), self.file, pickle.HIGHEST_PROTOCOL)
            self.rows, self.edits, self.held = [], bytearray(), 0

    def forwards(self) -> Iterator[tuple[tuple, int]]:
        yield from zip(reversed(self.rows), reversed(self.edits), strict=True)
        for at in reversed(self.spilled):
            self.file.seek(at)
            rows, edits = pickle.load(self.file)
            yield from zip(reversed(rows), reversed(edits), strict=True)
        if self.file is not None:
            self.file.close()


def _edited(key: str, log: Backlog) -> Iterator[tuple]:
    """Output rows of a conversation whose rows are all in the log."""
    state, place = 0, 0

    def inserted():
        nonlocal state, place
        row = (key, place, "I", ROLE[state], "", None, None, None)
        state, place = NEXT[state], place + 1
        return row

    for (turn, role, text, fault), edits in log.forwards():
        while (c := CHARS[edits >> 2 * state & 3]) == "I":
            yield inserted()
        new = ROLE[state] if c == "R" else role
        yield key, place, c, new, text, turn, role, FAULTS[fault]
        if c != "D":
            state = NEXT[state] if c == "R" else AFTER[state][role[:1]]
        place += 1
    while not END_STOPS[state]:
        yield inserted()


def _repair(frames: Iterator[pd.DataFrame], spill_bytes: int) -> Iterator[pd.DataFrame]:
    key, log, cost = None, None, END_COST
    out, size = [], 0
    columns = [c.split()[0] for c in ROW.split(", ")]

    def framed(rows):
        frame = pd.DataFrame(rows, columns=columns)
        return frame.astype({"turn": "Int64"})

    def finished():
        nonlocal out, size
        for row in _edited(key, log):
            out.append(row)
            size += 200 + len(row[4])
            if size >= OUT_BYTES:
                yield framed(out)
                out, size = [], 0

    for frame in frames:
        names = ("conv_id", "turn_text", "role", "text", "fault")
        for conv, turn, role, text, fault in zip(*(frame[c] for c in names), strict=True):
            if log is None or conv != key:
                if log is not None:
                    yield from finished()
                key, log, cost = conv, Backlog(spill_bytes), END_COST
            low = min(cost)
            initial = role[:1] if role[:1] in INITIALS else ""
            cost, edits = step(tuple(v - low for v in cost), initial, fault)
            log.push((None if turn is None else int(turn), role, text, fault), edits)
    if log is not None:
        yield from finished()
    if out:
        yield framed(out)


def with_faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, seen, fault): how often role and text came so far, and the number
    of the row's first fault, see FAULTS."""
    plain = turns.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    open_end = ~F.right(end, F.lit(1)).isin(".", "!", "?")
    fault = F.when(end == "", 1).when(F.col("seen") > 1, 2).when(open_end, 3).otherwise(0)
    return plain.withColumn("seen", seen).withColumn("fault", fault)


def repair(turns: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """(conv_id, place, edit, role, text, turn, old_role, fault): every row and every inserted one.

    `place` counts the edits of a conversation from 0; rows with edit D are not part of the repaired
    conversation, `role` is the repaired role. Input: conv_id, turn, role, text. A task holds about
    `spill_bytes` of a conversation in memory.
    """
    order = [F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("seen")]
    rows = with_faults(turns).sortWithinPartitions("conv_id", *order).select(
        "conv_id", F.col("turn").cast("string").alias("turn_text"), "role", "text", "fault"
    )
    kind = turns.schema["conv_id"].dataType
    return rows.mapInPandas(lambda frames: _repair(frames, spill_bytes), ROW).withColumn("conv_id", F.col("conv_id").cast(kind))


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    price = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
    key, first, done = None, True, []

    def close():
        gaps = last - low + 1 - distinct if distinct else 0
        done.append((key, gaps, *(faults[f] for f in FAULTS[1:]), illegal, cost, audit.decode(), sha.hexdigest()))

    for frame in frames:
        rows = zip(
            *(frame[c] for c in ("conv_id", "edit", "role", "text", "turn_text", "old_role", "fault")), strict=True
        )
        for conv, edit, role, text, turn, old, fault in rows:
            if first or conv != key:
                if not first:
                    close()
                key, first, sha, audit = conv, False, hashlib.sha256(), bytearray()
                faults = dict.fromkeys(FAULTS, 0)
                illegal = cost = distinct = kept = 0
                low = last = before = None
            audit += edit.encode()
            cost += price[edit] + (BROKEN if fault == "truncated" and edit != "D" else 0)
            if edit != "D":
                sha.update(f"{chr(10) * (kept > 0)}{role}:{text}".encode())
                kept += 1
            if edit != "I":
                faults[fault] += 1
                if before is not None and before[:1] + old[:1] not in LEGAL:
                    illegal += 1
                before = old
                if turn is not None and int(turn) != last:
                    last, distinct = int(turn), distinct + 1
                    low = last if low is None else low
        if len(done) >= 1000:
            yield pd.DataFrame(done, columns=[c.split()[0] for c in DIGEST.split(", ")])
            done = []
    if not first:
        close()
        yield pd.DataFrame(done, columns=[c.split()[0] for c in DIGEST.split(", ")])


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of `repair`: faults, cost, initials of the edits, hash of the result."""
    kind = repaired.schema["conv_id"].dataType
    rows = repaired.select(
        F.col("conv_id").cast("string").alias("conv_id"), "place", "edit", "role", "text",
        F.col("turn").cast("string").alias("turn_text"), "old_role", "fault",
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInPandas(_digest, DIGEST).withColumn("conv_id", F.col("conv_id").cast(kind))
