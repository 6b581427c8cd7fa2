r"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A repaired conversation's role initials are ``(s?(ua)+)?``. The turns are aligned to such a string of each feasible
length by Wagner and Fischer's table: a turn is kept, gets another role, or is deleted, and a turn may be
inserted. All even lengths' strings are beginnings of one string, all odd lengths' of another, so one table of each
parity holds the alignments to all its lengths. Ukkonen's band: a cell stays only while its cost and the least
that the turns left must cost lie within the incumbent, at first that of a greedy repair. A cell also goes if one of
its row that waits for the same role costs less, as what can follow is the same. The lengths of least cost are
traced back, each to its first audit in ASCII order, and the audits compared.

``audits`` works on a few bytes a turn; ``repaired`` carries the edits out on the texts, which stream through a task
in turn order and are never held for a conversation. A turn's edits are found from its initial and its fault
alone, so conversations of the same shape are worked out once a task.

Defined cases: a null role, text, or part of a damage key counts as one space; null turn numbers come first; equal turn
numbers go by role, then by the MD5 of the text; repeated rows are repeated turns, so all but the first are duplicates;
rows with a null conv_id form one conversation; a conversation of which all turns are dropped gives zeros; an empty
table gives no rows; further columns are ignored. A conversation's turns are audited in one task, as its one audit and its
one digest need: about a hundred bytes a turn for the digests seen, and the cells that tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import batch_of, bounded_batches

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: A turn's fault.
CLEAN, BLANK, DUPLICATE, TRUNCATED = "-", "b", "d", "t"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset({"su", "ua", "au"})
_SPACE = " \t\n\v\f\r"
_ROWS = 4000


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped, 2: repeated), with the faults that crc32(conv_id:turn) % 20 sets."""
    part = lambda name: F.coalesce(F.col(name).cast("long").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    return F.md5(F.col("text").cast("binary"))


# --- one conversation --------------------------------------------------------------------------------


def _wanted(start: str, j: int) -> str:
    """The role initial at place j of the string that begins with start and alternates from there."""
    return "s" if j < len(start) else "ua"[(j - len(start)) % 2]


def _greedy(initials: str, faults: str) -> int:
    """The cost of keeping what comes in turn and deleting all else."""
    kept = 0
    for c, f in zip(initials, faults, strict=True):
        kept += f == CLEAN and c == "ua"[kept % 2]
    return DELETE * (len(initials) - kept + kept % 2)


def _table(start: str, initials: str, faults: str, incumbent: int) -> list[dict[int, int]]:
    """For each number of turns taken: the least cost of each number of the string's places filled, within the band."""
    left = DELETE * sum(f != CLEAN for f in faults)  # each of these turns costs that much at least
    rows: list[dict[int, int]] = []
    row = {0: 0}
    for i in range(len(initials) + 1):
        for j in sorted(row):  # places filled by insertion
            while _wanted(start, j) != "s" and (cost := row[j] + INSERT) + left <= incumbent and cost < row.get(j + 1, incumbent + 1):
                row[j + 1] = cost
                j += 1
        least: dict[int, int] = {}
        for j, cost in row.items():
            if j > len(start):
                least[j % 2] = min(cost, least.get(j % 2, cost))
        row = {j: cost for j, cost in row.items() if cost + left <= incumbent and (j <= len(start) or cost == least[j % 2])}
        rows.append(row)
        if i == len(initials):
            return rows
        c, f = initials[i], faults[i]
        left -= DELETE * (f != CLEAN)
        further: dict[int, int] = {j: cost + DELETE for j, cost in row.items()}
        if f in (CLEAN, TRUNCATED):
            for j, cost in row.items():
                want = _wanted(start, j)
                if c == want or want != "s":
                    cost += (c != want) * REROLE + (f == TRUNCATED) * CUT
                    further[j + 1] = min(cost, further.get(j + 1, cost))
        row = further
    return rows


def _steps(start: str, initials: str, faults: str, rows: list[dict[int, int]], i: int, j: int) -> Iterator[tuple[str, int, int]]:
    """The edits, in ASCII order, that lead from a cell to a cell of the table at their own cost."""
    cost, last = rows[i][j], i == len(initials)
    if not last and rows[i + 1].get(j) == cost + DELETE:
        yield "D", i + 1, j
    want = _wanted(start, j)
    if want != "s" and rows[i].get(j + 1) == cost + INSERT:
        yield "I", i, j + 1
    if not last and faults[i] in (CLEAN, TRUNCATED) and (initials[i] == want or want != "s"):
        cost += (initials[i] != want) * REROLE + (faults[i] == TRUNCATED) * CUT
        if rows[i + 1].get(j + 1) == cost:
            yield "K" if initials[i] == want else "R", i + 1, j + 1


def _traced(start: str, initials: str, faults: str, rows: list[dict[int, int]], lengths: set[int]) -> str:
    """The first audit, in ASCII order, that ends in one of the lengths at its cost.

    Two lengths' audits are compared where they part: up to there they take the same cells.
    """
    n = len(initials)
    good: list[set[int]] = [set() for _ in rows]  # cells from which the end is reached
    good[n] |= lengths
    for i in range(n, -1, -1):
        for j in sorted(rows[i], reverse=True):
            if any(b in good[a] for _, a, b in _steps(start, initials, faults, rows, i, j)):
                good[i].add(j)
    i, j, audit = 0, 0, []
    while i < n or j not in lengths:
        letter, i, j = next((x, a, b) for x, a, b in _steps(start, initials, faults, rows, i, j) if b in good[a])
        audit.append(letter)
    return "".join(audit)


@lru_cache(maxsize=20_000)
def _known(initials: str, faults: str) -> tuple[int, str]:
    return _repair(initials, faults)


def _repair(initials: str, faults: str) -> tuple[int, str]:
    n, best = len(initials), _greedy(initials, faults)
    found: dict[str, tuple[list[dict[int, int]], set[int]]] = {}
    for start in ("", "s") if "s" in initials else ("",):
        rows = _table(start, initials, faults, best)
        for length, cost in rows[n].items():
            if length % 2 == len(start) and length != 1:
                if cost < best:
                    best, found = cost, {}
                if cost == best:
                    found.setdefault(start, (rows, set()))[1].add(length)
    return best, min(_traced(start, initials, faults, rows, lengths) for start, (rows, lengths) in found.items())


def repair(initials: str, faults: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits. initials: a character a turn; faults: CLEAN, BLANK, DUPLICATE or TRUNCATED each."""
    return _known(initials, faults) if len(initials) <= 64 else _repair(initials, faults)


# --- all conversations -------------------------------------------------------------------------------


@dataclass
class Facts:
    """What the audit needs of one conversation, fed turn by turn."""

    initials: list[str] = field(default_factory=list)
    faults: list[str] = field(default_factory=list)
    seen: set = field(default_factory=set)
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def feed(self, turn: int | None, role: str, digest: str, tail: str, copies: int) -> None:
        """tail: the text's last character that is no white space, empty where there is none."""
        if turn is not None and copies and turn != self.high:  # turns come in order
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        for _ in range(copies):
            fault = BLANK if not tail else DUPLICATE if (role, digest) in self.seen else CLEAN if tail in ".!?" else TRUNCATED
            self.seen.add((role, digest))
            self.initials.append(role[:1] or "?")
            self.faults.append(fault)

    def audit(self) -> dict:
        initials, faults = "".join(self.initials), "".join(self.faults)
        cost, audit = repair(initials, faults)
        out = {"gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns, "cost": cost, "audit": audit}
        out |= {name: faults.count(f) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
        return out | {"illegal": sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))}


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_AUDITS = pa.schema([*((n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation its faults and its cheapest repair. rows: conv_id, turn, role, text, copies, as damaged gives."""
    bounded_batches(rows.sparkSession)
    tail = F.right(F.rtrim(F.col("text"), F.lit(_SPACE)), F.lit(1))
    facts = rows.select("conv_id", "turn", "role", _digest().alias("digest"), tail.alias("tail"), "copies")
    facts = facts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, held = False, None, Facts()
        out: dict[str, list] = {n: [] for n in _AUDITS.names}

        def close() -> None:
            for name, value in ({"conv_id": conv} | held.audit()).items():
                out[name].append(value)

        for batch in batches:
            for new, *turn in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if not begun or new != conv:
                    if begun:
                        close()
                    begun, conv, held = True, new, Facts()
                held.feed(*turn)
            if len(out["audit"]) >= _ROWS:
                yield batch_of(_AUDITS, out)
                out = {n: [] for n in _AUDITS.names}
        if begun:
            close()
        yield batch_of(_AUDITS, out)

    return facts.mapInArrow(task, AUDITS)


REPAIRED = "conv_id long, position long, role string, text string, edit string"
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations' turns: conv_id, position (from 0), role, text and the edit that gave the turn.

    rows: as for audits; found: what audits gave. All turns of a conversation lie in one partition, in order, after
    a row of position null that says that the conversation is there.
    """
    bounded_batches(rows.sparkSession)
    turns = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "text", "copies")
    null = lambda kind: F.lit(None).cast(kind)
    heads = found.select("conv_id", F.lit(0).alias("kind"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("digest"), F.col("audit").alias("text"), F.lit(0).alias("copies"))
    ordered = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, position, start = None, "", 0, 0, 0
        out: dict[str, list] = {n: [] for n in _REPAIRED.names}

        def emit(edit: str, role: str, text: str) -> None:
            nonlocal position
            if edit in "RI":
                role = ROLES["ua"[(position - start) % 2]]
            for name, value in zip(_REPAIRED.names, (conv, position, role, text, edit), strict=True):
                out[name].append(value)
            position += 1

        def inserts() -> None:
            nonlocal at
            while audit.startswith("I", at):
                emit("I", "", "")
                at += 1

        for batch in batches:
            for new, kind, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == 0:
                    conv, audit, at, position = new, text, 0, 0
                    start = (len(audit) - audit.count("D")) % 2
                    for name, value in zip(_REPAIRED.names, (conv, None, None, None, None), strict=True):
                        out[name].append(value)
                    inserts()
                for _ in range(copies):
                    if audit[at] != "D":
                        emit(audit[at], role, text)
                    at += 1
                    inserts()
            if len(out["text"]) >= _ROWS:
                yield batch_of(_REPAIRED, out)
                out = {n: [] for n in _REPAIRED.names}
        yield batch_of(_REPAIRED, out)

    return ordered.select("conv_id", "kind", "role", "text", "copies").mapInArrow(task, REPAIRED)


DIGESTS = "conv_id long, repaired_sha256 string"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation the SHA-256 of its repaired role:text lines. turns: as repaired orders them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hashed = None, None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _DIGESTS.names}
            for new, position, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if position is None:
                    if hashed:
                        out["conv_id"].append(conv)
                        out["repaired_sha256"].append(hashed.hexdigest())
                    conv, hashed = new, hashlib.sha256()
                else:
                    hashed.update(f"{chr(10) if position else ''}{role}:{text}".encode("utf-8", "replace"))
            yield batch_of(_DIGESTS, out)
        if hashed:
            yield batch_of(_DIGESTS, {"conv_id": [conv], "repaired_sha256": [hashed.hexdigest()]})

    return turns.select("conv_id", "position", "role", "text").mapInArrow(task, DIGESTS)
