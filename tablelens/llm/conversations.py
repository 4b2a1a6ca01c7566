"""Repair of the role structure of conversations (operator 12): generalised LR.

The roles of a sound conversation are a sentence of a small grammar: perhaps a
system message, then turns of user and assistant, or nothing. A conversation
that isn't is repaired by the cheapest edits, with ties broken by the letters
of the edits.

1. Tables. LR states and SLR actions are made from GRAMMAR.
2. Stacks. A row shifts its role (Keep), shifts another role (Rerole) or shifts
   nothing (Delete); between rows roles may be shifted without a row (Insert).
   All ways go on at once in a graph-structured stack, whose nodes share what
   lies under them. The grammar is left-recursive, so stacks stay at most four
   high and there is one way only to lie under a state: equal tops are equal
   stacks, and of those that meet the least (cost, audit) stays. (Of two audits
   of the same cost that have used the same rows neither is the beginning of the
   other, so the order of two audits can't change later.) A top that costs more
   than FAR above the cheapest can't win any more and goes.
3. Steps are remembered. What a row does depends on its role and fault, on the
   tops, on their costs above the cheapest and on the order of their audits:
   there are few such cases, so a row takes a look-up, not a search.
4. Rows. One shuffle by the conversation's key and a sort; a task reads its rows
   in order, and each top carries the digest of its own repaired text. So a
   task holds no texts, and of a conversation of any length only a reference a
   row, for the audit. Rows seen earlier are numbered by a window over the same
   partitions, so nothing else is shuffled.

Whatever is null is one space: keys in what `damage` hashes, roles and texts.
Rows are taken by turn (nulls first), then by role and text. A row without a
role, or with one that the grammar doesn't know, can be reroled or deleted, not kept.
Conversations of which no row is left have zeros, an empty audit and the digest of nothing.
Null keys are one conversation. An empty table gives an empty result. One
conversation is one value of the result, with a digest that must be taken in
order, so its rows meet in one task, as a stream.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, named

#: The start symbol first; terminals are initials of roles.
GRAMMAR = (("chat", ("turns",)), ("chat", ()), ("turns", ("turns", "u", "a")), ("turns", ("u", "a")), ("turns", ("s", "u", "a")))
END = "$"
ROLE = {"u": "user", "a": "assistant"}
RIGHT = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: From the cheapest top any other's way can be gone on with two inserted roles (3 + 3) or one and a deleted row (3 + 4).
FAR = 7
#: What a row is, first fault first.
GOOD, BLANK, SEEN, CUT = 0, 1, 2, 3
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# ---------------------------------------------------------------- tables


def _closure(items: frozenset) -> frozenset:
    out = set(items)
    while True:
        wanted = {GRAMMAR[r][1][d] for r, d in out if d < len(GRAMMAR[r][1])}
        more = {(r, 0) for r, (head, _) in enumerate(GRAMMAR) if head in wanted} - out
        if not more:
            return frozenset(out)
        out |= more


def _goto(items: frozenset, symbol: str) -> frozenset:
    return _closure(frozenset((r, d + 1) for r, d in items if GRAMMAR[r][1][d : d + 1] == (symbol,)))


@functools.cache
def _follow() -> dict[str, set[str]]:
    """Terminals after each nonterminal (no nonterminal but the start symbol is ever empty)."""
    heads = {h for h, _ in GRAMMAR}

    def first(symbol: str, seen: frozenset = frozenset()) -> set[str]:
        if symbol not in heads:
            return {symbol}
        return set().union(*[first(b[0], seen | {symbol}) for h, b in GRAMMAR if h == symbol and b and b[0] not in seen | {symbol}], set())

    out = {h: set() for h in heads}
    out[GRAMMAR[0][0]].add(END)
    while True:
        before = {h: set(v) for h, v in out.items()}
        for head, body in GRAMMAR:
            for symbol, after in zip(body, (*body[1:], None)):
                if symbol in heads:
                    out[symbol] |= first(after) if after else out[head]
        if before == out:
            return out


@functools.cache
def _states() -> list[frozenset]:
    """The start state first; others as they are reached."""
    out = [_closure(frozenset((r, 0) for r, (h, _) in enumerate(GRAMMAR) if h == GRAMMAR[0][0]))]
    symbols = sorted({x for _, body in GRAMMAR for x in body})
    for items in out:
        out += [new for new in dict.fromkeys(_goto(items, x) for x in symbols) if new and new not in out]
    return out


@functools.cache
def shift(stack: tuple[int, ...], symbol: str) -> tuple[int, ...] | None:
    """The stack after the reductions that the symbol asks for and its shift
    (END: whether the stack is a whole sentence); None if it doesn't fit."""
    states = _states()
    while True:
        items = states[stack[-1]]
        new = _goto(items, symbol)
        if new:
            return _settled((*stack, states.index(new)))
        ready = [r for r, d in items if d == len(GRAMMAR[r][1]) and symbol in _follow()[GRAMMAR[r][0]]]
        if not ready:
            return None
        if GRAMMAR[ready[0]][0] == GRAMMAR[0][0]:
            return stack
        stack = _reduced(stack, ready[0])


def _reduced(stack: tuple[int, ...], rule: int) -> tuple[int, ...]:
    head, body = GRAMMAR[rule]
    stack = stack[: len(stack) - len(body)]
    return (*stack, _states().index(_goto(_states()[stack[-1]], head)))


def _settled(stack: tuple[int, ...]) -> tuple[int, ...]:
    """Reductions that come whatever follows are made at once, so that tops meet early."""
    while len(items := _states()[stack[-1]]) == 1:
        ((rule, dot),) = items
        if dot < len(GRAMMAR[rule][1]):
            break
        stack = _reduced(stack, rule)
    return stack


# ---------------------------------------------------------------- stacks

#: A configuration: the stacks alive with their costs above the cheapest, by the order of their audits.
START = (((0,), 0),)


def _inserted(config: tuple) -> dict[tuple, tuple]:
    """For each stack that can be had without another row the least (cost, number
    of the stack that it comes from, edits), and the roles inserted."""
    best = {stack: ((cost, i, ""), "") for i, (stack, cost) in enumerate(config)}
    todo = list(best)
    while todo:
        stack = todo.pop(0)
        (cost, i, edits), roles = best[stack]
        for x in ROLE:
            new = shift(stack, x)
            if new and (new not in best or (cost + INSERT, i, edits + "I") < best[new][0]):
                best[new] = ((cost + INSERT, i, edits + "I"), roles + x)
                todo.append(new)
    return best


@functools.cache
def step(config: tuple, initial: str, fault: int) -> tuple[int, tuple, tuple]:
    """One row: what the cheapest top costs more, the next configuration, and for
    each of its stacks (stack it comes from, edits, roles inserted before, role of the row).
    The role is "" for a row that is deleted and None for one that keeps its own."""
    found: dict[tuple, tuple] = {}
    for stack, ((cost, i, edits), roles) in _inserted(config).items():
        ways = [(DELETE, "D", "", stack)]
        if fault not in (BLANK, SEEN):
            more = TRUNCATED if fault == CUT else 0
            ways += [(more, "K", None, shift(stack, initial))] if initial in ("s", *ROLE) else []
            ways += [(REROLE + more, "R", ROLE[x], shift(stack, x)) for x in ROLE]
        for price, letter, role, new in ways:
            rank = (cost + price, i, edits + letter)
            if new and (new not in found or rank < found[new][0]):
                found[new] = (rank, roles, role)
    least = min(rank[0] for rank, _, _ in found.values())
    kept = sorted((rank[1:], rank[0], stack, roles, role) for stack, (rank, roles, role) in found.items() if rank[0] <= least + FAR)
    return (
        least,
        tuple((stack, cost - least) for _, cost, stack, _, _ in kept),
        tuple((i, edits, roles, role) for (i, edits), _, _, roles, role in kept),
    )


@functools.cache
def finish(config: tuple) -> tuple[int, int, str, str]:
    """(cost, stack, edits, roles inserted) of the best whole sentence."""
    whole = [(rank, roles) for stack, (rank, roles) in _inserted(config).items() if shift(stack, END) is not None]
    (cost, i, edits), roles = min(whole, key=lambda x: x[0])
    return cost, i, edits, roles


class Repair:
    """One conversation, row by row. Each stack has a digest of its text so far (and whether it has any)."""

    def __init__(self) -> None:
        self.config, self.cost, self.moves = START, 0, []
        self.texts = [(hashlib.sha256(), False)]

    def add(self, role: str, text: str, fault: int) -> None:
        more, self.config, moves = step(self.config, role[:1], fault)
        self.cost += more
        self.moves.append(moves)
        self.texts = [self._written(i, roles, None if new == "" else f"{role if new is None else new}:{text}") for i, _, roles, new in moves]

    def _written(self, i: int, roles: str, line: str | None) -> tuple:
        digest, some = self.texts[i]
        lines = [f"{ROLE[x]}:" for x in roles] + ([] if line is None else [line])
        if not lines:
            return digest, some
        digest = digest.copy()
        digest.update(("\n" * some + "\n".join(lines)).encode())
        return digest, True

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, hex digest of the repaired text)."""
        more, i, edits, roles = finish(self.config)
        digest, _ = self._written(i, roles, None)
        parts = [edits]
        for moves in reversed(self.moves):
            i, edits, _, _ = moves[i]
            parts.append(edits)
        return self.cost + more, "".join(reversed(parts)), digest.hexdigest()


# ---------------------------------------------------------------- rows


def or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, there): every row as it is after the damage; a
    dropped row stays without role and text and isn't there."""
    c, t, r, x = (named(rows, n) for n in (conv, turn, role, text))
    kind = F.crc32(F.concat(or_space(c), F.lit(":"), or_space(t)).cast("binary")) % 20
    slim = rows.select(c.alias("conv"), t.cast("long").alias("turn"), or_space(r).alias("role"), or_space(x).alias("text"), kind.alias("kind"))
    there = F.col("kind") != 0
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    slim = slim.select(
        "conv", "turn", there.alias("there"), "kind",
        F.when(there, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(there, body).alias("text"),
    )
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return slim.select("conv", "turn", "role", "text", "there", again.alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, there) with `fault`, each conversation's in order within one partition."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumn("x", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "role", "x").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(bare == "", BLANK).when(seen > 1, SEEN).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(GOOD)
    rows = rows.select("conv", "turn", "there", "role", "text", fault.alias("fault"), seen.alias("nth"))
    return rows.sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text", "nth")


def repair(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text, there), as `damage` gives them: a row for each
    conv with COUNTS, audit and digest (of the repaired rows' `role:text`, by line)."""
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", *COUNTS, "audit", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key = None  # of the conversation that is open: its key in a list, so that null is a key

        def close() -> None:
            cost, audit, digest = state.end()
            gaps = last - first + 1 - turns if turns else 0
            out.append((key[0], gaps, *faults[1:], illegal, cost, audit, digest))

        for b in batches:
            kinds = [b.schema.field("conv").type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            for conv, turn, there, role, text, fault in zip(*(b.column(c).to_pylist() for c in ("conv", "turn", "there", "role", "text", "fault"))):
                if key is None or key[0] != conv:
                    if key:
                        close()
                    key, state, before = [conv], Repair(), None
                    first = last = None
                    turns = illegal = 0
                    faults = [0, 0, 0, 0]
                if not there:
                    continue
                if turn is not None and turn != last:
                    first, last, turns = turn if first is None else first, turn, turns + 1
                illegal += before is not None and before + role[:1] not in RIGHT
                before = role[:1]
                faults[fault] += 1
                state.add(role, text, fault)
            if len(out) > 1000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out.clear()
        if key:
            close()
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    ordered = _ordered(rows).select("conv", "turn", "there", "role", "text", "fault")
    return map_arrow(ordered, run, f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, digest string")


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The repaired conversations: (conv, place, edit, role, text), from the rows and
    their `repair`. The audit goes ahead of its conversation's rows in the same stream."""
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = _ordered(rows).filter("there").select("conv", "turn", "role", "text", F.lit("").alias("audit"), F.lit(1).alias("after"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    both = ordered.unionByName(report.select("conv", *none, "audit", F.lit(0).alias("after")))
    both = both.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "after", F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, place, out, stack = None, "", 0, 0, [], (0,)

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, stack
            out.append((key, place, edit, role, text))
            place, stack = place + 1, shift(stack, role[:1])

        def fits() -> str:
            """The role that an inserted or reroled row must have."""
            return next(ROLE[x] for x in ROLE if shift(stack, x))

        def insert() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                at += 1
                put("I", fits(), "")

        kinds = None
        for b in batches:
            kinds = [b.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            for conv, role, text, letters, after in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text", "audit", "after"))):
                if not after:
                    insert()
                    key, audit, at, place, stack = conv, letters, 0, 0, (0,)
                    continue
                insert()
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(edit, role if edit == "K" else fits(), text)
            if len(out) > 1000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv", "place", "edit", "role", "text"])
                out.clear()
        if kinds:
            insert()
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv", "place", "edit", "role", "text"])

    return map_arrow(both.select("conv", "role", "text", "audit", "after"), run, f"conv {kind}, place long, edit string, role string, text string")


def damaged_and_repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every conversation of the table after damage: COUNTS, audit and the digest of its repaired rows."""
    found = repair(damage(rows, conv, turn, role, text))
    return found.select(F.col("conv").alias(conv), *COUNTS, "audit", F.col("digest").alias("repaired_sha256"))
