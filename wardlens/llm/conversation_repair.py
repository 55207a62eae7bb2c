"""Repair of conversation structure by depth-first branch and bound.

A conversation is a path through four states (nothing yet, after the system turn, after a user turn, after an
assistant turn) that must read ``(s?(ua)+)?``. Its rows are kept, given another role or deleted, and empty turns
inserted, at least cost; of equally cheap edit lists the ASCII-least wins. A search node is (rows used, state). The
search walks an explicit stack, prunes by a lower bound of the rows left against the incumbent (cost, audit), and a
table per node drops every prefix that is no better than one that has reached the node before.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import crc_mod

START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept turn with this initial, and the role that an inserted or changed turn takes in a state.
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
DONE = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
#: Cost at most by which a path in state x can be turned into one that serves wherever state y would: (x, y).
TURN = {(USER, START): 7, (ASSISTANT, START): 4, (SYSTEM, START): 10, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): 3,
        (START, SYSTEM): 0, (START, USER): 3, (SYSTEM, USER): 3, (ASSISTANT, USER): 3, (START, ASSISTANT): 0, (SYSTEM, ASSISTANT): 6, (USER, ASSISTANT): 3}
#: Rows that one search takes; longer conversations go through it block by block with all states they may be in.
BLOCK_ROWS = 32
BLANK, DUPLICATE, CUT, SOUND = range(4)


def row_floor(initial: str, fault: int) -> int:
    """The least that a row can cost in any state."""
    if fault in (BLANK, DUPLICATE):
        return DELETE
    extra = TRUNCATED if fault == CUT else 0
    return min(DELETE, extra + (0 if initial in ("s", "u", "a") else REROLE))


def search(rows: list[tuple[str, int]], sources: dict[int, tuple[int, str]], last: bool) -> dict[int, tuple[int, str]]:
    """Best (cost, audit) per state after ``rows`` (initial, fault), from ``sources``: state -> (cost, audit so far).

    With ``last`` only the states in which a conversation may end are given.
    """
    n = len(rows)
    floor = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        floor[i] = floor[i + 1] + row_floor(*rows[i])
    table: dict[tuple[int, int], tuple[int, str]] = {}
    best: dict[int, tuple[int, str]] = {}
    stack: list[tuple[int, int, int, str]] = []

    def visit(i: int, state: int, cost: int, audit: str) -> None:
        old = table.get((i, state))
        if old is None or (cost, audit) < old:
            table[i, state] = (cost, audit)
            stack.append((i, state, cost, audit))

    def hopeless(i: int, state: int, cost: int) -> bool:
        bound = cost + floor[i]
        if last:
            # An open user or system turn still needs its answer inserted, or a row that is neither cut nor deleted.
            if i == n:
                bound += {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}[state]
            return bool(best) and bound > min(best.values())[0]
        return bool(best) and bound > min(best.values())[0] + max(TURN.values())  # such a path would be dominated

    for state, (cost, audit) in sorted(sources.items(), key=lambda x: x[1], reverse=True):
        visit(0, state, cost, audit)
    while stack:
        i, state, cost, audit = stack.pop()
        if table[i, state] != (cost, audit) or hopeless(i, state, cost):
            continue
        if i == n and (not last or state in DONE) and (state not in best or (cost, audit) < best[state]):
            best[state] = (cost, audit)
        # The last pushed is searched first: keep, then change, then insert, then delete.
        if i < n:
            initial, fault = rows[i]
            visit(i + 1, state, cost + DELETE, audit + "D")
        visit(i, NEXT[state], cost + INSERT, audit + "I")
        if i < n and fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            visit(i + 1, NEXT[state], cost + REROLE + extra, audit + "R")
            if (state, initial) in AFTER:
                visit(i + 1, AFTER[state, initial], cost + extra, audit + "K")
    return best


def undominated(paths: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """Paths that no other one beats by more than the cost of turning it into their state."""
    return {y: p for y, p in paths.items() if not any(q[0] + TURN[x, y] < p[0] for x, q in paths.items() if (x, y) in TURN)}


class Conversation:
    """One conversation, fed row by row in order; holds a block of rows and those that no decision has reached yet."""

    def __init__(self, conv: object):
        self.conv, self.counts, self.gap_turns, self.low, self.high, self.turn = conv, [0, 0, 0, 0], 0, None, None, None
        self.illegal, self.before = 0, None
        self.rows: list[tuple[str, int]] = []
        self.pending: list[tuple[str, str]] = []
        self.paths, self.audit, self.state, self.place, self.cost = {START: (0, "")}, [], START, 0, 0
        self.sha = hashlib.sha256()

    def add(self, turn: int | None, role: str, text: str, fault: int) -> list[dict]:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.gap_turns += turn != self.turn
            self.high = self.turn = turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        self.counts[fault] += 1
        out = self.solve(False) if len(self.rows) == BLOCK_ROWS else []
        self.rows.append((initial, fault))
        self.pending.append((role, text))
        return out

    def solve(self, last: bool) -> list[dict]:
        """Search the block; the turns on which all surviving paths agree are settled and returned."""
        self.paths = search(self.rows, self.paths, last)
        self.rows = []
        if last:
            self.paths = dict([min(self.paths.items(), key=lambda x: x[1])])
            self.cost = next(iter(self.paths.values()))[0]
        else:
            self.paths = undominated(self.paths)
        sure = os.path.commonprefix([a for _, a in self.paths.values()])
        self.paths = {s: (c, a[len(sure):]) for s, (c, a) in self.paths.items()}
        self.audit.append(sure)
        out, at = [], 0
        for e in sure:
            role, text = (ROLE[self.state], "") if e == "I" else self.pending[at]
            at += e != "I"
            if e == "D":
                continue
            role = ROLE[self.state] if e == "R" else role
            self.state = NEXT[self.state] if e in "IR" else AFTER[self.state, role[:1]]
            self.sha.update(f"{chr(10) if self.place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            out.append({"conv_id": self.conv, "place": self.place, "role": role, "text": text, "edit": e})
            self.place += 1
        self.pending = self.pending[at:]
        return out

    def report(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.gap_turns
        return {"conv_id": self.conv, "gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[CUT],
                "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "place bigint, role string, text string, edit string"


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): rows with faults planted by crc32 of ``conv:turn`` modulo 20 (nulls read as one space).

    0 drops the row (it stays as a mark without ``present``), 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = crc_mod(F.concat(known(conv), F.lit(":"), known(turn)), 20)
    t = F.when(h == 1, "").when(h == 2, F.translate(known(text), ".!?", "")).otherwise(known(text))
    return df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.when(h == 4, "user").otherwise(known(role)).alias("role"),
                     t.alias("text"), (h != 0).alias("present"), F.explode(F.when(h == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _fault(role: Column, text: Column) -> Column:
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", role, F.sha2(text, 256)).orderBy(F.asc_nulls_first("turn"))) > 1
    said = F.rtrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(said == "", BLANK).when(seen, DUPLICATE).when(F.right(said, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None,
           turns: bool = False) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With ``turns`` the repaired turns instead: conv_id, place (from 0), role, text, edit (K, R or I). Rows are taken by turn, nulls
    first, ties by role and then text. A null text or role is one space; a role's initial is its first letter, and one
    that is empty or not s, u or a cannot be kept. Rows without ``present`` only name their conversation, which has zeros, an empty audit and the hash
    of nothing if it has no other. Null conv_ids are one conversation; other columns are not read; an empty table gives no rows.

    Each conversation is one ordered stream, since its hash is. One shuffle brings its rows together; Spark sorts them (and spills) to
    tell copies and again by turn. A worker reads its sorted rows batch by batch and holds a block of
    ``BLOCK_ROWS`` rows, the rows on which the at most four open paths differ, and the audit, however long it is.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), known(role).alias("role"), known(text).alias("text"),
                     (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    rows = rows.repartition("conv_id").withColumn("fault", _fault(F.col("role"), F.col("text")))  # the window needs no shuffle of its own
    rows = rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {TURNS if turns else REPORT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: pa.Schema | None = None
        now: Conversation | None = None

        def closed() -> list[dict]:
            last = now.solve(True)
            return last if turns else [now.report()]

        for b in chain(batches, [None]):
            out: list[dict] = []
            if b is None:
                out += closed() if now else []
            else:
                made = pa.schema([b.schema.field("conv_id"), *_fields(turns)])
                for c, t, r, x, p, f in zip(*(col.to_pylist() for col in b.columns), strict=True):
                    if now is None or now.conv != c:
                        out += closed() if now else []
                        now = Conversation(c)
                    settled = now.add(t, r, x, f) if p else []
                    out += settled if turns else []
            if out:
                yield pa.RecordBatch.from_pylist(out, made)

    return rows.mapInArrow(run, schema)


def _fields(turns: bool) -> list[pa.Field]:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return [pa.field(name, kinds[kind]) for name, kind in (x.split() for x in (TURNS if turns else REPORT).split(", "))]
