"""Conversation structure repair: the cheapest edits that make roles alternate, found by iterative-deepening A*.

Every row of a conversation is kept, given another role or deleted, and rows without text may be
inserted, so that the initials of the roles read ``(s?(ua)+)?``. Among the cheapest scripts the one
that comes first in ASCII order is taken.

The search goes depth-first in the ASCII order of the edits (Delete, Insert, Keep, Rerole) under a
cost bound that is raised to the least cost beyond it until a path is accepted; that path is the
answer. What may still be needed is estimated from below by the exact costs of short stretches of
rows from their best state, added up. A table of failed states (row, role before it) remembers how
much is needed from there at least, so that no state is gone through twice with as little to spend.

A conversation is cut into blocks of 64 rows, which are searched by themselves, for each state before
and after; the blocks are then put together from the left. A script ends each row with a letter that
is no Insert, so no script of a block starts another one, and the first in ASCII order of the whole
is made of the first ones of its blocks. So the blocks of one very long conversation are searched by
all tasks. What one task goes through in order is a conversation's row codes, some bytes each, and
its texts as a sorted stream of which one row is held at a time. The script itself is one cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, parts_of

# Fixed by the contract: what is blank, what ends a text, and the costs.
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: Rows of a block, and of the longest stretch whose exact cost the estimate uses.
BLOCK = 64
STRETCH = 4
# States by the role before: none, system, user, assistant; and the role that each takes next.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"u": USER, "a": ASSISTANT}
ACCEPTED = (EMPTY, ASSISTANT)
NEVER = 1 << 60

# A row's code: D must go, else its role's initial (x for others); a capital one lacks its end.
FORCED = "D"


def _moves(code: str | None, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows taken, state after) in ASCII order; ``code`` is None behind the last row."""
    fill = AFTER[NEXT[state]]
    if code is None:
        return [("I", INSERT, 0, fill)]
    if code == FORCED:
        return [("D", DELETE, 1, state), ("I", INSERT, 0, fill)]
    role, cut = code.lower(), CUT if code.isupper() else 0
    moves = [("D", DELETE, 1, state), ("I", INSERT, 0, fill)]
    if role == NEXT[state]:
        moves.append(("K", cut, 1, fill))
    elif role == "s" and state == EMPTY:
        moves.append(("K", cut, 1, SYSTEM))
    moves.append(("R", REROLE + cut, 1, fill))
    return moves


@lru_cache(1 << 14)
def _least(codes: str) -> int:
    """Cost of a short stretch of rows from its best state to its best state."""
    costs = [0, 0, 0, 0]
    for code in codes:
        after = [NEVER] * 4
        for _ in range(2):
            for state in range(4):
                fill = AFTER[NEXT[state]]
                costs[fill] = min(costs[fill], costs[state] + INSERT)
        for state in range(4):
            for _, cost, taken, to in _moves(code, state):
                if taken:
                    after[to] = min(after[to], costs[state] + cost)
        costs = after
    return min(costs)


def estimates(codes: str) -> list[int]:
    """For each row a cost that the rows from it on need at least."""
    need = [0] * (len(codes) + 1)
    for i in range(len(codes) - 1, -1, -1):
        need[i] = max(_least(codes[i : i + w]) + need[i + w] for w in range(1, min(STRETCH, len(codes) - i) + 1))
    return need


@lru_cache(1 << 14)
def search(codes: str, entry: int, leave: int | None) -> tuple[int, str] | None:
    """(cost, script) of the cheapest, then ASCII-least way through ``codes`` from state ``entry``.

    It ends in state ``leave`` with the last row's letter (one row at least); with None it ends a
    conversation: in an accepted state, and Inserts may follow the last row. None if there is no way.
    """
    # Nothing leads back to these states; all others are reached from anywhere by Inserts before a row.
    if leave == EMPTY and entry != EMPTY:
        return None
    if leave == SYSTEM and entry != SYSTEM and (entry != EMPTY or "s" not in codes.lower()):
        return None
    n = len(codes)
    estimate = estimates(codes)
    failed: dict[tuple[int, int], int] = {}
    script: list[str] = []

    def visit(i: int, state: int, left: int) -> int:
        """-1 if a path is accepted within ``left``, else what is needed at least, more than ``left``."""
        if i == n:
            if state == leave or (leave is None and state in ACCEPTED):
                return -1
            if leave is not None:
                return NEVER
        needed = NEVER
        for edit, cost, taken, to in _moves(codes[i] if i < n else None, state):
            need = failed.get((i + taken, to), estimate[i + taken])
            if cost + need <= left:
                script.append(edit)
                need = visit(i + taken, to, left - cost)
                if need < 0:
                    return -1
                script.pop()
            needed = min(needed, cost + need)
        failed[i, state] = needed
        return needed

    bound = estimate[0]
    while bound < NEVER:
        needed = visit(0, entry, bound)
        if needed < 0:
            return bound, "".join(script)
        bound = needed
    raise AssertionError((codes, entry, leave))


def ways(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, script) through a block; a last one ends in EMPTY for any accepted state."""
    found = []
    for entry in (EMPTY,) if first else range(4):
        for leave in (None,) if last else range(4):
            way = search(codes, entry, leave)
            if way:
                found.append((entry, leave or EMPTY, *way))
    return found


def join_blocks(blocks: Iterable[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """Cost and script of a conversation from the ways through its blocks, in order."""
    # Per state: cost so far and the place of its script so far among those of all states.
    best = {EMPTY: (0, 0)}
    chosen: list[dict[int, tuple[int, str]]] = []
    for block in blocks:
        after: dict[int, tuple] = {}
        for entry, leave, cost, script in block:
            if entry in best:
                way = (best[entry][0] + cost, best[entry][1], script, entry)
                after[leave] = min(after.get(leave, way), way)
        order = sorted(after, key=lambda s: after[s][1:3])
        best = {state: (after[state][0], place) for place, state in enumerate(order)}
        chosen.append({state: (way[3], way[2]) for state, way in after.items()})
    state, parts = EMPTY, []
    for ways_in in reversed(chosen):
        state, script = ways_in[state]
        parts.append(script)
    return best[EMPTY][0] if chosen else 0, "".join(reversed(parts))


def _key(conv_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))


def conversations(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, conv_id): the key that this module uses for each conversation's id."""
    return turns.select(_key(conv_col).alias("conv"), F.col(conv_col).alias("conv_id")).distinct()


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows under this module's own names; nulls of role and text as one space, the conversation as a key."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    return turns.select(
        _key(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.sha2(text, 256).alias("text_key"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Equal rows once, without text: how many, blank, cut (lacks its end) and first (role and text are new)."""
    body = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select(
        "conv", "turn", "role", "text_key",
        (body == "").alias("blank"),
        (~F.right(body, F.lit(1)).isin(*ENDS)).alias("cut"),
    ).groupBy("conv", "turn", "role", "text_key").agg(
        F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")
    )
    # The first of equal role and text is found by counting down to one row, not by gathering them.
    firsts = narrow.groupBy("conv", "role", "text_key").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))).alias("least")
    ).select(
        F.col("conv").alias("f_conv"), F.col("role").alias("f_role"), F.col("text_key").alias("f_key"), F.col("least.turn").alias("f_turn")
    )
    same = (
        (F.col("conv") == F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("text_key") == F.col("f_key"))
        & F.col("turn").eqNullSafe(F.col("f_turn"))
    )
    return narrow.join(firsts, same, "left").select(
        "conv", "turn", "role", "text_key", "n", "blank", "cut", F.col("f_conv").isNotNull().alias("first")
    )


def _in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    return df.repartition(parts_of(df.sparkSession), "conv").sortWithinPartitions("conv", *order)


_BLOCKS = (
    "conv string, block long, codes string, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long"
)


def _cut_blocks(stream: Iterator[tuple]) -> Iterator[tuple]:
    """Blocks of row codes of each conversation; the counts stand on its last one."""
    for conv, group in groupby(stream, itemgetter(0)):
        codes, block = "", 0
        blanks = repeats = cuts = illegal = distinct = 0
        low = high = before = None
        for _, turn, role, _, n, blank, cut, first in group:
            if turn is not None and turn != high:
                low, high, distinct = (turn if low is None else low), turn, distinct + 1
            fresh = int(first and not blank)
            blanks += n * blank
            repeats += (n - fresh) * (not blank)
            cuts += fresh and cut
            initial = role[:1]
            illegal += (before is not None and before + initial not in ("su", "ua", "au")) + (n - 1)
            before = initial
            code = initial if initial and initial in "sua" else "x"
            row_codes = [code.upper() if cut else code] if fresh else []
            left = n - fresh
            while row_codes or left:
                take = min(left, BLOCK)
                codes += "".join(row_codes) + FORCED * take
                row_codes, left = [], left - take
                while len(codes) > BLOCK:
                    yield conv, block, codes[:BLOCK], False, 0, 0, 0, 0, 0
                    codes, block = codes[BLOCK:], block + 1
        gaps = 0 if low is None else high - low + 1 - distinct
        yield conv, block, codes, True, gaps, blanks, repeats, cuts, illegal


def _search_blocks(stream: Iterator[tuple]) -> Iterator[tuple]:
    for conv, block, codes, last, *counts in stream:
        found = ways(codes, block == 0, last)
        yield conv, block, last, [4 * a + b for a, b, _, _ in found], [c for _, _, c, _ in found], ",".join(
            s for _, _, _, s in found
        ), *counts


_WAYS = (
    "conv string, block long, last boolean, states array<int>, costs array<long>, scripts string, "
    "gaps long, blank long, duplicate long, truncated long, illegal long"
)


def _join_ways(stream: Iterator[tuple]) -> Iterator[tuple]:
    for conv, group in groupby(stream, itemgetter(0)):
        counts: list = []

        def blocks(rows=group, counts=counts):
            for _, _, _, states, costs, scripts, *more in rows:
                counts[:] = more
                yield [(s // 4, s % 4, c, w) for s, c, w in zip(states, costs, scripts.split(","))]

        cost, audit = join_blocks(blocks())
        yield conv, *counts, cost, audit


_PLAN = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plan_repairs(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: conv (its key), gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn, nulls first, then by role and the text's SHA-256. A row's first fault counts:
    blank (nothing but spaces), duplicate (role and text came before) or truncated (does not end in
    ``.``, ``!`` or ``?``). ``gaps`` counts missing turns, ``illegal`` neighbours whose roles do not follow
    each other, ``audit`` has one letter per edit. Null roles and texts count as one space; a null id
    is a conversation of its own; repeated rows are duplicates; an empty table gives an empty result. Other
    columns are ignored.
    """
    marked = _marked(_rows(turns, conv_col, turn_col, role_col, text_col))
    blocks = mapped(_in_order(marked, F.col("turn").asc_nulls_first(), "role", "text_key"), _BLOCKS, _cut_blocks)
    searched = mapped(blocks.repartition(parts_of(turns.sparkSession), "conv", "block"), _WAYS, _search_blocks)
    return mapped(_in_order(searched, "block"), _PLAN, _join_ways)


def edited(stream: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, row number, edit, role, text) of what stays, from sorted (conv, audit or None, role, text).

    The script of a conversation comes before its rows.
    """
    for conv, group in groupby(stream, itemgetter(0)):
        audit, state, number = next(group)[1], EMPTY, 0
        at = 0

        def insert():
            nonlocal state, number, at
            while at < len(audit) and audit[at] == "I":
                role = NEXT[state]
                yield conv, number, "I", ROLES[role], ""
                state, number, at = AFTER[role], number + 1, at + 1

        for _, _, role, text in group:
            yield from insert()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES[NEXT[state]]
            state = SYSTEM if role[:1] == "s" else AFTER[role[:1]]
            yield conv, number, edit, role, text
            number += 1
        yield from insert()


def _with_plans(turns: DataFrame, plans: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """Scripts and rows in one sorted stream: each conversation's script, then its rows in order."""
    rows = _rows(turns, *columns).select("conv", "turn", "role", "text", "text_key", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"))
    null = lambda kind: F.lit(None).cast(kind)
    scripts = plans.select(
        "conv", null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"),
        null("string").alias("text_key"), "audit", F.lit(0).alias("kind"),
    )
    ordered = _in_order(scripts.unionByName(rows), "kind", F.col("turn").asc_nulls_first(), "role", "text_key")
    return ordered.select("conv", "audit", "role", "text")


def repaired_turns(
    turns: DataFrame, plans: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The rows of all conversations after their edits: conv, number, edit, role, text."""
    return mapped(
        _with_plans(turns, plans, (conv_col, turn_col, role_col, text_col)),
        "conv string, number long, edit string, role string, text string", edited,
    )


def repaired_digests(
    turns: DataFrame, plans: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, repaired_sha256) of ``role:text`` lines, newline-joined; a conversation without a row left has none.

    A digest of a whole goes through it in order, so a conversation is one task's stream here, held row by row.
    """

    def digest(stream: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(edited(stream), itemgetter(0)):
            total = hashlib.sha256()
            for _, number, _, role, text in group:
                total.update(f"{chr(10) if number else ''}{role}:{text}".encode())
            yield conv, total.hexdigest()

    return mapped(_with_plans(turns, plans, (conv_col, turn_col, role_col, text_col)), "conv string, repaired_sha256 string", digest)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` with a part of the rows damaged by a checksum of conversation and turn.

    Of 20 rows one is dropped, one loses its text, one its ends of sentences, one comes twice and one is
    said by the user. Nulls are one space, but a null turn or conversation stays null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    return (
        turns.withColumn("__kind", kind)
        .filter("__kind != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("__kind") == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
            F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
            F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
        )
        .drop("__copy")
    )
