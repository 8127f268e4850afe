"""Conversation repair: the cheapest edits that make a conversation's roles follow a grammar.

The edits are a path on the lattice of (turn index, grammar state), which is never built: Dijkstra's search makes a node's
edges when it comes off the queue. The queue's key is (cost, audit), so of equally cheap edits those of the ASCII-least audit
come first, and the search stops at the first accepting end node.

Conversations stream through tasks in order. A long one goes window by window: a window's search starts from all states that
the last one ended in, with their keys, and gives each state's best path; what these share is final and leaves memory.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import map_batches

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
ACCEPTED = (START, AFTER_ASSISTANT)
#: The grammar (s?(ua)+)? as steps from state to state by a role's initial.
STEPS = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER, (AFTER_USER, "a"): AFTER_ASSISTANT, (AFTER_ASSISTANT, "u"): AFTER_USER}
#: The role that may follow in a state by edits.
NEXT = {START: "user", AFTER_SYSTEM: "user", AFTER_USER: "assistant", AFTER_ASSISTANT: "user"}
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
SPACE = " \t\n\x0b\f\r"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of ``conversations`` after damage by crc32(`conv_id:turn`) % 20.

    0 drops a row (it stays as a gone one, to name its conversation), 1 empties its text, 2 removes its [.!?], 3 repeats it,
    4 sets its role to user. Nulls of role, text and of the key's parts are one space; a null turn stays null.
    """
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hurt = own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return hurt.withColumn("__nth", F.explode(F.sequence(F.lit(1), "times"))).drop("__nth", "times")


def faulted(rows: DataFrame) -> DataFrame:
    """rows with ``fault``: blank, duplicate, truncated or null, each conversation in one partition and in order.

    Rows of one turn are in order of role and text. One shuffle: duplicates are found in the partitions it makes.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("gone"), None).when(bare == "", BLANK).when(again, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
    order = ("conv_id", "gone", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == DUPLICATE)  # of equal rows the first isn't one
    return rows.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions(*order)


def search(rows: list[tuple], starts: dict[int, tuple[int, str]], final: bool) -> dict[int, tuple[int, str, int, list]]:
    """By end state: cost, audit, the state it started in, and the steps (edit, role, text) of the best path over ``rows``.

    rows: (role, text, fault). starts: cost and audit by state. final: only the best accepting end is wanted.
    """
    queue = [(cost, audit, 0, state, k, None, None) for k, (state, (cost, audit)) in enumerate(starts.items())]
    heapq.heapify(queue)
    pushed = count(len(queue))  # of equal paths to a node the first one stays
    came, found = {}, {}
    while queue:
        cost, audit, at, state, _, before, step = heapq.heappop(queue)
        if (at, state) in came:
            continue
        came[at, state] = before, step
        if at == len(rows) and (not final or state in ACCEPTED):
            node, steps = (at, state), []
            while came[node][0]:
                steps.append(came[node][1])
                node = came[node][0]
            found[state] = cost, audit, node[1], steps[::-1]
            if final:
                break

        def go(edit, more, to, after, step, cost=cost, audit=audit, node=(at, state)):
            if (to, after) not in came:
                heapq.heappush(queue, (cost + more, audit + edit, to, after, next(pushed), node, step))

        named = NEXT[state]
        after = STEPS[state, named[0]]
        go("I", INSERT, at, after, ("I", named, ""))
        if at < len(rows):
            role, text, fault = rows[at]
            go("D", DELETE, at + 1, state, ("D", role, None))
            if fault not in (BLANK, DUPLICATE):
                left = LEFT_TRUNCATED if fault == TRUNCATED else 0
                kept = STEPS.get((state, role[0])) if role else state
                if kept is not None:
                    go("K", left, at + 1, kept, ("K", role, text))
                go("R", REROLE + left, at + 1, after, ("R", named, text))
    return found


class Repair:
    """Finds a conversation's faults and edits while its rows pass by, in order."""

    def __init__(self, window: int = 256, window_chars: int = 1 << 22):
        self.window, self.window_chars = window, window_chars
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.least = self.most = None
        self.turns = 0

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns

    def see(self, turn, role: str, fault, before) -> None:
        setattr(self, fault, getattr(self, fault) + 1) if fault else None
        if before is not None and before[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn

    def steps(self, rows):
        """(edit, role, text) of the cheapest edits; text is None for deleted rows. rows: (turn, role, text, fault)."""
        live, held, chars, before = {START: (0, [])}, [], 0, None  # by state: cost and steps that aren't final yet
        for turn, role, text, fault in rows:
            if len(held) >= self.window or chars >= self.window_chars:
                live = self.moved(held, live, False)
                shared = self.shared([steps for _, steps in live.values()])
                yield from self.settled(next(iter(live.values()))[1][:shared])
                live = {state: (cost, steps[shared:]) for state, (cost, steps) in live.items()}
                held, chars = [], 0
            self.see(turn, role, fault, before)
            before = role
            text = None if fault in (BLANK, DUPLICATE) else text  # these are deleted on any path
            held.append((role, text, fault))
            chars += len(text or "")
        ((self.cost, steps),) = self.moved(held, live, True).values()
        yield from self.settled(steps)

    def settled(self, steps: list[tuple]) -> list[tuple]:
        self.audit += [s[0] for s in steps]
        return steps

    @staticmethod
    def moved(rows: list[tuple], live: dict, final: bool) -> dict:
        """The live paths after a window of rows."""
        found = search(rows, {state: (cost, "".join(s[0] for s in steps)) for state, (cost, steps) in live.items()}, final)
        return {state: (cost, live[start][1] + steps) for state, (cost, _, start, steps) in found.items()}

    @staticmethod
    def shared(paths: list[list]) -> int:
        """How many first steps all paths have in common."""
        n = 0
        for own in zip(*paths, strict=False):
            if any(s != own[0] for s in own):
                break
            n += 1
        return n


def conversations_of(batches):
    """(conv_id, rows that aren't gone) one after the other."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "fault")), strict=True))
    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, (r[2:] for r in own if not r[1])


def repaired(rows: DataFrame, size: int = 1024) -> DataFrame:
    """conv_id, place, edit, role and text of the rows of repaired conversations. rows: as ``faulted`` gives them."""

    def run(batches):
        out = []
        for conv, own in conversations_of(batches):
            place = 0
            for edit, role, text in Repair().steps(own):
                if edit != "D":
                    out.append((conv, place, edit, role, text))
                    place += 1
                if len(out) >= size:
                    yield table(out)
                    out = []
        if out:
            yield table(out)

    def table(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "place", "edit", "role", "text"])

    return map_batches(rows, run, "conv_id long, place long, edit string, role string, text string")


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def reports(rows: DataFrame, size: int = 1024) -> DataFrame:
    """A row of faults, cost, audit and the digest of the repaired rows for each conversation. rows: as ``faulted`` gives them."""

    def run(batches):
        out = []
        for conv, own in conversations_of(batches):
            repair, digest, first = Repair(), hashlib.sha256(), True
            for edit, role, text in repair.steps(own):
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            out.append((conv, *(getattr(repair, c) for c in REPORT), "".join(repair.audit), digest.hexdigest()))
            if len(out) >= size:
                yield table(out)
                out = []
        if out:
            yield table(out)

    def table(out):
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", *REPORT, "audit", "repaired_sha256"])

    return map_batches(rows, run, f"conv_id long, {', '.join(f'{c} long' for c in REPORT)}, audit string, repaired_sha256 string")


def undamaged(rows: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of ``damaged``: for repair without damage."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("gone"))


def repair_damaged(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation after damage.

    Each row's first fault counts. Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (required for blank and duplicate
    rows), Insert a user or assistant row of empty text 2; a truncated row that isn't deleted adds 1. audit: the cheapest
    edits' initials, ASCII-least of ties, after which the roles' initials are ``(s?(ua)+)?``. Rows of one turn are taken in
    order of role and text; a null turn comes first and counts in no gap; a role of no characters has no initial, so it may
    be kept anywhere; null conv_ids are one conversation. A conversation without rows after damage has zeros, an empty audit
    and the digest of nothing. Repeated rows are duplicates. An empty table gives an empty one; other columns are left out.
    Very long conversations and texts stream; a task holds a window of rows, the rows whose edits are still open, and the
    audit, which is a cell of the result.
    """
    return reports(faulted(damaged(rows)))
