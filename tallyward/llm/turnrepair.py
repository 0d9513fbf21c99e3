"""Repair of conversations by generalised LR parsing of their roles.

The grammar of role initials is RULES; its LR automaton is built from them. The parser reads a
conversation's rows in order and keeps, as a graph-structured stack, one entry for each stack
top that edits of the rows so far can reach: keep (0), rerole to user or assistant
(1), delete (2), insert an empty turn (5). Entries with equal tops are merged: the least
(cost, audit) stays, as equal tops accept the same rests. Each entry carries the running digest of its repaired text,
so rows are read once, and a task holds no row but the present one.

Rows are damaged and judged by native expressions. Where a text of the same role came before is found
by an aggregation over digests; conversations then come to tasks as sorted streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import col, small_batches

#: The grammar of role initials: no turn, or pairs of user and assistant behind at most one system turn.
RULES = (("S", ""), ("S", "Q"), ("Q", "ua"), ("Q", "sua"), ("Q", "Qua"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A top that costs so much more than the cheapest can't win: one insertion gives the cheapest the same parity, and one deletion takes a system turn.
BEHIND = INSERT + DELETE
#: Letters of an audit that are held as one text before they become a block.
BLOCK = 4096
#: Fixed value: white space of the contracts.
BLANKS = " \t\n\x0b\f\r"
_LARGEST = 2**63 - 1

Items = frozenset[tuple[int, int]]


def _closure(items: set[tuple[int, int]]) -> Items:
    found, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        right = RULES[rule][1]
        for k, (left, _) in enumerate(RULES):
            if dot < len(right) and right[dot] == left and (k, 0) not in found:
                found.add((k, 0))
                todo.append((k, 0))
    return frozenset(found)


@cache
def automaton() -> tuple[list[Items], dict[tuple[int, str], int]]:
    """The states (sets of rule and dot) and the transitions (state, symbol) -> state."""
    states, moves = [_closure({(k, 0) for k, (left, _) in enumerate(RULES) if left == "S"})], {}
    for at, state in enumerate(states):  # grows meanwhile
        for symbol in sorted({RULES[k][1][dot] for k, dot in state if dot < len(RULES[k][1])}):
            to = _closure({(k, dot + 1) for k, dot in state if dot < len(RULES[k][1]) and RULES[k][1][dot] == symbol})
            if to not in states:
                states.append(to)
            moves[at, symbol] = states.index(to)
    return states, moves


@cache
def shift(stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
    """The stack behind a symbol, after all reductions of whole right sides; None where the symbol can't stand."""
    states, moves = automaton()
    if (stack[-1], symbol) not in moves:
        return None
    stack = (*stack, moves[stack[-1], symbol])
    while done := [k for k, dot in states[stack[-1]] if dot == len(RULES[k][1]) > 0 and RULES[k][0] != "S"]:
        left, right = RULES[done[0]]
        stack = stack[: -len(right)]
        stack = (*stack, moves[stack[-1], left])
    return stack


def accepts(stack: tuple[int, ...]) -> bool:
    return any(RULES[k][0] == "S" and dot == len(RULES[k][1]) for k, dot in automaton()[0][stack[-1]])


@cache
def _inserted(stack: tuple[int, ...]) -> list[tuple[str, tuple[int, ...]]]:
    """(initials, stack) of no, one and two insertions; more never pay."""
    out = [("", stack)]
    for _ in range(2):
        out += [(s + x, to) for s, at in out for x in ROLES if (to := shift(at, x)) and (s + x, to) not in out]
    return out


@cache
def moves_of(stack: tuple[int, ...], initial: str) -> list[tuple[str, int, str, str, tuple[int, ...]]]:
    """What may become of a row that isn't deleted: (letters, cost, inserted initials, new initial or empty to keep it, stack)."""
    out = []
    for inserted, at in _inserted(stack):
        head, cost = "I" * len(inserted), INSERT * len(inserted)
        if to := shift(at, initial):
            out.append((head + "K", cost, inserted, "", to))
        out += [(head + "R", cost + REROLE, inserted, x, to) for x in ROLES if x != initial and (to := shift(at, x))]
    return out


class _Entry:
    """A stack with the cheapest edits that lead to it. rank orders the audits of all present entries; none of them begins another, as each ends with the same row's letter."""

    __slots__ = ("stack", "cost", "rank", "blocks", "letters", "digest")

    def __init__(self, stack, cost, rank, blocks, letters, digest) -> None:
        self.stack, self.cost, self.rank, self.blocks, self.letters, self.digest = stack, cost, rank, blocks, letters, digest

    def audit(self) -> str:
        parts, block = [self.letters], self.blocks
        while block:
            block, text = block
            parts.append(text)
        return "".join(reversed(parts))


def _line(digest, line: str):
    """A digest goes on with a line; None stands for the digest of no line yet."""
    new = hashlib.sha256() if digest is None else digest.copy()
    new.update((line if digest is None else f"\n{line}").encode())
    return new


class Repair:
    """The parse of one conversation, row by row."""

    def __init__(self) -> None:
        self.entries = [_Entry((0,), 0, 0, None, "", None)]

    def row(self, role: str, text: str, delete: bool, truncated: bool) -> None:
        best: dict[int, tuple] = {}
        for e in self.entries:
            options = [("D", DELETE, "", "D", e.stack)]
            if not delete:
                options += moves_of(e.stack, role[:1])
            for letters, cost, inserted, to, stack in options:
                whole = e.cost + cost + (TRUNCATED if truncated and to != "D" else 0)
                found = (whole, e.rank, letters, e, inserted, to, stack)
                if stack[-1] not in best or found[:3] < best[stack[-1]][:3]:
                    best[stack[-1]] = found
        least = min(x[0] for x in best.values())
        kept = sorted((x for x in best.values() if x[0] <= least + BEHIND), key=lambda x: x[1:3])
        self.entries = [self._next(rank, x, role, text) for rank, x in enumerate(kept)]

    @staticmethod
    def _next(rank: int, found: tuple, role: str, text: str) -> _Entry:
        cost, _, letters, e, inserted, to, stack = found
        digest = e.digest
        for x in inserted:
            digest = _line(digest, f"{ROLES[x]}:")
        if to != "D":
            digest = _line(digest, f"{ROLES[to] if to else role}:{text}")
        blocks, new = e.blocks, e.letters + letters
        if len(new) > BLOCK:
            blocks, new = (blocks, new), ""
        return _Entry(stack, cost, rank, blocks, new, digest)

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired lines)."""
        found = [(e.cost + INSERT * len(x), e.rank, "I" * len(x), e, x) for e in self.entries for x, at in _inserted(e.stack) if accepts(at)]
        cost, _, letters, e, inserted = min(found, key=lambda f: f[:3])
        digest = e.digest
        for x in inserted:
            digest = _line(digest, f"{ROLES[x]}:")
        return cost, e.audit() + letters, (digest or hashlib.sha256()).hexdigest()


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times (how often the row comes: 0, 1 or 2), by crc32 of `conv_id:turn` mod 20: 0 drops a row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes its role user. Nulls (of role and text, and inside the crc's text) count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), way.alias("_way"))
    text = F.when(F.col("_way") == 1, "").when(F.col("_way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_way") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_way") == 0, 0).when(F.col("_way") == 3, 2).otherwise(1).alias("times"))


def as_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times, undamaged; nulls count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), F.lit(1).alias("times"))


def _last_character(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_READ = ("conv_id", "turn", "role", "text", "times", "_last", "_digest", "_again")


class _Conversation:
    def __init__(self, conv: object) -> None:
        self.conv, self.repair, self.turns, self.before, self.initial = conv, Repair(), None, None, None
        self.counts = dict.fromkeys(_COUNTS, 0)

    def row(self, turn: int | None, role: str, text: str, times: int, last: str, digest: bytes, again: bool) -> None:
        if turn is not None and times:
            if self.turns is None:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        for _ in range(times):
            seen = again or self.before == (turn, digest)
            self.before = (turn, digest)
            fault = "blank" if not last else "duplicate" if seen else "truncated" if last not in ".!?" else None
            if fault:
                self.counts[fault] += 1
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.counts["illegal"] += 1
            self.initial = role[:1]
            self.repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def done(self) -> tuple:
        if self.turns:
            self.counts["gaps"] = min(self.turns[1] - self.turns[0] + 1 - self.turns[2], _LARGEST)
        self.counts["cost"], audit, digest = self.repair.end()
        return (self.conv, *(self.counts[c] for c in _COUNTS), audit, digest)


def repaired(rows: DataFrame) -> DataFrame:
    """A row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; rows as damaged() or as_rows() give them.

    Rows are taken by turn (nulls first); ties by role and text, and equal rows are neighbours. Null conv_ids are one conversation. A conversation whose
    rows are all gone has zeros, an empty audit and the digest of nothing; an empty table gives no rows. A conversation's digest needs
    its rows in order, so one task streams it; it holds a letter of the audit for each row and stack top, and of texts the present one alone.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    told = rows.withColumns({"_last": _last_character(F.col("text")), "_digest": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))})
    alive = told.filter("times > 0")
    # texts that come again, with the turn they came in first; sums of tasks meet, so that many copies are no hot key
    first = alive.groupBy(F.col("conv_id").alias("_conv"), F.col("_digest").alias("_same")).agg(F.min(F.struct("turn")).alias("_first"), F.max(F.struct("turn")).alias("_latest")).filter(~F.col("_first").eqNullSafe(F.col("_latest")))
    joined = told.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_digest") == F.col("_same")), "left")
    again = F.col("_same").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    ready = joined.select("conv_id", "turn", "role", F.when(F.col("times") > 0, F.col("text")).otherwise("").alias("text"), "times", "_last", "_digest", again.alias("_again"))
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, like = None, [], pa.int64()

        def out() -> pa.RecordBatch:
            kinds = [like, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            like = col(batch, "conv_id").type
            for conv, *row in zip(*(col(batch, c).to_pylist() for c in _READ), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.done())
                    now = _Conversation(conv)
                now.row(*row)
            if done:
                yield out()
                done.clear()
        if now is not None:
            done.append(now.done())
            yield out()

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return small_batches(ready).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)
