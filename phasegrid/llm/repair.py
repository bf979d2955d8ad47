"""Conversation structure repair: the cheapest edits, by depth-first branch-and-bound, that make the roles alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.llm.common import arrow_schema

#: What one edit costs, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Codes of role initials; every other one is OTHER. Faults: the first that holds counts.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Role states of the grammar s?(ua)+ or nothing: what the kept roles end with. OPEN is their very beginning.
OPEN, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Role that may come next, by state, and the state it leads to; a system role may come first only.
NEXT_ROLE = (USER, USER, ASSISTANT, USER)
NEXT_STATE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
LAST_STATES = (OPEN, AFTER_A)
NEVER = 1 << 60
GIVEN_NAME = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, there) after the stated damage; a dropped row stays with ``there`` false.

    Nulls read as one space, in the hashed key as in role and text.
    """
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        blank(F.col(f"`{role}`")).alias("role"), blank(F.col(f"`{text}`")).alias("text"),
    )
    kind = F.crc32(F.concat(blank(F.col("conv_id")), F.lit(":"), blank(F.col("turn")))) % 20
    return rows.select("*", kind.alias("kind")).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("kind") != 0).alias("there"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
    ).drop("again")


def initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)


def fault() -> Column:
    """Blank or truncated, from the row alone."""
    said = F.rtrim("text", F.lit(BLANKS))
    return F.when(said == "", BLANK).when(~F.substring(said, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)


def fingerprint() -> Column:
    """Equal for equal role and text only (128 bits); also the order of rows of one turn and role."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _moves(state: int, row: int):
    """(letter, cost, next state, rows used) of the edits at a row code, in the order of their letters."""
    role, what = row & 3, row >> 2
    yield "D", DELETE, state, 1
    yield "I", INSERT, NEXT_STATE[state], 0
    if what in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if what == CUT else 0
    if role == NEXT_ROLE[state]:
        yield "K", KEEP + more, NEXT_STATE[state], 1
    elif role == SYSTEM and state == OPEN:
        yield "K", KEEP + more, AFTER_S, 1
    yield "R", REROLE + more, NEXT_STATE[state], 1


#: Edits by row code (role and fault) and state; one more code stands for the end, where only inserts are left.
MOVES = [[tuple(_moves(state, row)) for state in range(4)] for row in range(16)]
END = [(("I", INSERT, NEXT_STATE[state], 0),) for state in range(4)]


def suffix_bounds(rows: bytes) -> list[list[int]]:
    """For every row and state a cost that no completion of the rest undercuts, found from the last row backwards."""
    bounds = [[0 if s in LAST_STATES else NEVER for s in range(4)]]
    for row in (None, *reversed(rows)):
        after = bounds[-1]
        if row is None:
            here = after
        else:
            here = [min(c + after[to] for _, c, to, used in MOVES[row][s] if used) for s in range(4)]
        for _ in range(2):  # two inserts lead to every state
            here = [min(here[s], INSERT + here[NEXT_STATE[s]]) for s in range(4)]
        if row is None:
            bounds[-1] = here
        else:
            bounds.append(here)
    return bounds[::-1]


def first_incumbent(rows: bytes, bounds: list[list[int]]) -> int:
    """Cost of the repair found by always taking the edit whose cost and suffix bound are least."""
    i, state, cost = 0, OPEN, 0
    while not (i == len(rows) and state in LAST_STATES):
        moves = END[state] if i == len(rows) else MOVES[rows[i]][state]
        _, more, state, used = min(moves, key=lambda m: (m[1] + bounds[i + m[3]][m[2]], m[0]))
        i, cost = i + used, cost + more
    return cost


def repair(rows: bytes) -> tuple[int, str]:
    """The least cost of edits that make the roles fit, and of the edit strings at that cost the ASCII-least.

    Depth first with an explicit stack, edits of a node in the order of their letters, so that prefixes reach a node in
    ASCII order. A prefix is dropped if its cost and the suffix bound do not undercut the incumbent, or if the
    dominance table of its node (row, state) holds a prefix that costs no more: that one came earlier and is ASCII-less.
    The search ends when the stack is empty or the incumbent meets the bound of the root, which proves it optimal.
    """
    n, bounds = len(rows), suffix_bounds(rows)
    best_cost, best = first_incumbent(rows, bounds) + 1, ""  # its audit need not be the least of its cost
    reached = [[NEVER] * 4 for _ in range(n + 1)]
    path: list[str] = []
    stack = [(0, OPEN, 0, 0, "")]
    while stack and best_cost > bounds[0][OPEN]:
        i, state, cost, depth, letter = stack.pop()
        if cost + bounds[i][state] >= best_cost or cost >= reached[i][state]:
            continue
        reached[i][state] = cost
        del path[max(depth - 1, 0) :]
        if depth:
            path.append(letter)
        if i == n and state in LAST_STATES:
            best_cost, best = cost, "".join(path)
            continue
        moves = END[state] if i == n else MOVES[rows[i]][state]
        for edit, more, to, used in reversed(moves):
            if cost + more + bounds[i + used][to] < best_cost:
                stack.append((i + used, to, cost + more, depth + 1, edit))
    return best_cost, best


FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class Conversation:
    """Codes of one conversation's rows as they pass by: one byte for each row."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.codes, self.turns, self.low, self.high = conv_id, bytearray(), 0, None, None

    def add(self, turn: int | None, code: int) -> None:
        self.codes.append(code)
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1

    def result(self) -> tuple:
        codes = self.codes
        faults = np.bincount(np.frombuffer(bytes(codes), np.uint8) >> 2, minlength=4).tolist()
        illegal = sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, *repair(bytes(codes)))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of rows sorted by it; code -1 stands for a dropped row."""
    schema, now, out = arrow_schema(FOUND), None, []
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for batch in batches:
        for conv_id, turn, code in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.result())
                now = Conversation(conv_id)
            if code >= 0:
                now.add(turn, code)
        if len(out) >= 4096:
            yield make(out)
            out = []
    if now is not None:
        out.append(now.result())
    if out:
        yield make(out)


def _assembled(audit: str, rows) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation; ``rows`` is read as the edits ask for it."""
    state = OPEN
    for edit in audit:
        if edit == "I":
            yield GIVEN_NAME[NEXT_ROLE[state]], ""
            state = NEXT_STATE[state]
            continue
        role, text = next(rows)
        if edit == "K":
            yield role, text
            state = AFTER_S if role[:1] == "s" else NEXT_STATE[state]
        elif edit == "R":
            yield GIVEN_NAME[NEXT_ROLE[state]], text
            state = NEXT_STATE[state]


def _digested(batches: Iterator[pa.RecordBatch], schema: pa.Schema, texts: bool) -> Iterator[pa.RecordBatch]:
    """Results come before the rows of their conversation; texts pass through the digest one after the other."""

    def stream():
        for batch in batches:
            yield from batch.to_pylist()

    def finish(result, rows):
        digest, parts = hashlib.sha256(), []
        for k, (role, text) in enumerate(_assembled(result["audit"], rows)):
            said = f"{role}:{text}"
            digest.update((said if k == 0 else "\n" + said).encode())
            if texts:
                parts.append({"role": role, "text": text})
        return {f.name: result.get(f.name) for f in schema} | {"repaired_sha256": digest.hexdigest()} | ({"repaired": parts} if texts else {})

    waiting, out, held, result = stream(), [], 0, None
    row = next(waiting, None)
    while row is not None:
        result, row = row, None

        def own():
            nonlocal row
            for row in waiting:
                if row["audit"] is not None:
                    return
                yield row["role"], row["text"]
            row = None

        rows = own()
        out.append(finish(result, rows))
        for _ in rows:  # the rows behind the last edit, if any
            pass
        held += sum(len(p["text"]) for p in out[-1].get("repaired", ()))
        if len(out) >= 2048 or held > 16_000_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def repair_conversations(
    rows: DataFrame, there: str | None = None, texts: bool = False, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired conversation, one row for each conversation id.

    Rows stand by turn, null turns first; rows of one turn by role and then by a digest of role and text, so equal rows
    are neighbours and the result does not depend on partitions. Null role and text read as one space; null ids are one
    conversation. ``there`` names a boolean column: a conversation of which no row is there has zeros, an empty audit
    and the digest of nothing. An empty table gives no rows; other columns are not read. With ``texts`` the repaired rows
    come as ``repaired``.

    Two shuffles by conversation. The first moves 30 bytes a row (turn, code, fingerprint): its sort spills, and a task
    holds one byte for each row of the conversation it is at, as many as the audit has. The second moves the texts once;
    they stream through the digest behind the audit of their conversation and are never held together. With ``texts``
    a repaired conversation is one value, as such a column needs.
    """
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    named = rows.select(
        F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        blank(role).alias("role"), blank(text).alias("text"), (F.col(f"`{there}`") if there else F.lit(True)).alias("there"),
    ).withColumn("mark", fingerprint())
    order = ["turn", "first", "mark"]
    coded = named.select(
        "conv_id", "turn", F.col("role").alias("first"), "mark", "there", (initial() + 4 * fault()).alias("code")
    )
    # the window needs no shuffle of its own: its partitions lie within those of the conversations
    earlier = F.row_number().over(Window.partitionBy("conv_id", "there", "mark").orderBy(*order)) > 1
    repeated = F.col("there") & earlier & (F.shiftright("code", 2) != BLANK)
    placed = coded.repartition("conv_id").withColumn("code", F.when(repeated, F.col("code").bitwiseAND(3) + 4 * DUPLICATE).otherwise(F.col("code")))
    placed = placed.withColumn("code", F.when(F.col("there"), F.col("code")).otherwise(-1))
    judged = (
        placed.sortWithinPartitions("conv_id", *order).select("conv_id", "turn", F.col("code").cast("int").alias("code")).mapInArrow(_judged, FOUND)
    )
    numbers = [f.split(" ")[0] for f in FOUND.split(", ")[1:-1]]
    nothing = [F.lit(None).cast("long").alias(n) for n in numbers]
    both = judged.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("first"),
                         F.lit(None).cast("binary").alias("mark"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *numbers, "audit")
    told = named.where("there").select("conv_id", F.lit(1).alias("place"), "turn", F.col("role").alias("first"), "mark", "role", "text", *nothing,
                                       F.lit(None).cast("string").alias("audit"))
    ddl = FOUND + ", repaired_sha256 string"
    schema = arrow_schema(ddl)
    if texts:
        ddl += ", repaired array<struct<role: string, text: string>>"
        schema = schema.append(pa.field("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))))
    return (
        both.unionByName(told).repartition("conv_id").sortWithinPartitions("conv_id", "place", *order)
        .select("conv_id", "role", "text", *numbers, "audit")
        .mapInArrow(lambda batches: _digested(batches, schema, texts), ddl)
    )

