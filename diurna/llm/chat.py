"""Chat formatting with minimum-cost role repair.

A conversation's turns are read in order of turn (nulls first; ties by role and text). The legal sequences are: an optional
system turn, then user and assistant in turns, user first, assistant last. A dynamic program over this automaton
chooses for each turn the cheapest of: keep it; relabel it; merge it into the turn before; drop nothing, but insert empty turns before it.
Roles are read in lower case without spaces around; other roles than the three, and null, fit none and cost a relabel.

Each turn is a small matrix of costs between states, and (min, +) products of such matrices are associative. So a conversation is cut
into segments of at most ``SEGMENT`` rows that any task may handle. Rows are sorted by ranges over all tasks, whatever their turn
numbers are, so a long conversation, or one with a single turn number, is spread over tasks as well; a task counts its rows into
segments and gives each one's matrix. A second pass chooses the states between segments (one tiny matrix for each), and a third
repairs and renders each segment. A segment's rendering continues the last one's, so a conversation's text is its segments' end
to end, however long it is.

Rows with a null conv_id take no part. Null texts are empty, very long ones are whole. Repeated rows are turns like others. A
table without rows gives none. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEGMENT = 1024
# states: what the last rendered turn was
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1.0, 3.0, 2.0
FAR = float("inf")


def _routes() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns from one state to a turn of another."""
    out = {}
    for a in range(4):
        level: list[tuple[int, tuple[int, ...]]] = [(a, ())]
        seen: set[int] = set()
        while level:
            new = []
            for s, way in level:
                for t in NEXT[s]:
                    if t not in seen:
                        seen.add(t)
                        out[a, t] = way
                        new.append((t, (*way, t)))
            level = new
    return out


ROUTES = _routes()


def options(role: str, previous: int) -> Iterable[tuple[float, int, str, tuple[int, ...]]]:
    """(cost, state after, what is done, empty turns before) for a turn after a state."""
    for state, name in ROLES.items():
        change = 0.0 if name == role else RELABEL
        if state == previous:
            yield change + MERGE, state, "merge" if not change else "relabel+merge", ()
        if (way := ROUTES.get((previous, state))) is not None:
            yield change + INSERT * len(way), state, "keep" if not change else "relabel", way


STEP = {r: [list(options(r, s)) for s in range(4)] for r in (*ROLES.values(), "")}


def clean(role: str | None) -> str:
    role = (role or "").strip().lower()
    return role if role in STEP else ""


def cost_matrix(roles: list[str]) -> np.ndarray:
    """Least costs from each state before the turns to each state after."""
    m = np.full((4, 4), FAR)
    np.fill_diagonal(m, 0)
    single = {r: _matrix(r) for r in set(roles)}
    for r in roles:
        m = (m[:, :, None] + single[r][None, :, :]).min(axis=1)
    return m


def _matrix(role: str) -> np.ndarray:
    m = np.full((4, 4), FAR)
    for s in range(4):
        for cost, t, _, _ in STEP[role][s]:
            m[s, t] = min(m[s, t], cost)
    return m


def repair(roles: list[str], first: int, last: int) -> tuple[float, list[tuple[int, str, tuple[int, ...]]]]:
    """(cost, for each turn its state, what is done and the empty turns before) from state first to state last."""
    cost = [FAR] * 4
    cost[first] = 0.0
    back: list[list[tuple[int, str, tuple[int, ...]] | None]] = []
    for r in roles:
        new, come = [FAR] * 4, [None] * 4
        for s in range(4):
            if cost[s] < FAR:
                for c, t, what, way in STEP[r][s]:
                    if cost[s] + c < new[t]:
                        new[t], come[t] = cost[s] + c, (s, what, way)
        cost = new
        back.append(come)
    out, state = [], last
    for come in reversed(back):
        s, what, way = come[state]
        out.append((state, what, way))
        state = s
    return cost[last], out[::-1]


def closing(state: int) -> float:
    """A conversation ends with the assistant: at most one empty turn more."""
    return {START: FAR, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0.0}[state]


def between(matrices: list[np.ndarray]) -> list[int]:
    """The states before, between and after segments of least cost."""
    cost = np.full(4, FAR)
    cost[START] = 0
    back = []
    for m in matrices:
        all_costs = cost[:, None] + m
        back.append(all_costs.argmin(axis=0))
        cost = all_costs.min(axis=0)
    states = [int(np.argmin(cost + np.array([closing(s) for s in range(4)])))]
    for come in reversed(back):
        states.append(int(come[states[-1]]))
    return states[::-1]


def head(state: int, opened: bool) -> str:
    return ("<|im_end|>\n" if opened else "") + f"<|im_start|>{ROLES[state]}\n"


def render(texts: list[str], done: list[tuple[int, str, tuple[int, ...]]], opened: bool, last: bool, state: int) -> tuple[str, list[str]]:
    """(rendered text, roles of the turns it opens)."""
    out, roles = [], []
    for text, (state, what, way) in zip(texts, done, strict=True):
        for s in way:
            out.append(head(s, opened))
            roles.append(ROLES[s])
            opened = True
        if what.endswith("merge"):
            out.append("\n\n" + text)
        else:
            out.append(head(state, opened) + text)
            roles.append(ROLES[state])
            opened = True
    if last:
        for s in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(state, ()):
            out.append(head(s, opened))
            roles.append(ROLES[s])
            opened = True
        out.append("<|im_end|>\n" if opened else "")
    return "".join(out), roles


def format_chat(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, segment, n_segments, n_turns, cost, n_changed, roles, rendered)``: one row for each segment of a conversation.

    cost is the segment's (the last one's with closing), roles are those of the turns it opens.
    """
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their segment and place in it; a segment's last row has its matrix."""
        from pyspark import TaskContext

        part = (TaskContext.get().partitionId() << 32) - 1
        known: dict[tuple[str, ...], list[float]] = {}
        last: tuple | None = None  # the row that is held back: it may be a segment's last
        roles: list[str] = []

        def matrix() -> list[float]:
            key = tuple(roles)
            if key not in known:
                if len(known) > 50_000:
                    known.clear()
                known[key] = cost_matrix(list(key)).ravel().tolist()
            return known[key]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "part", "place", "role", "text", "m"])

        for batch in batches:
            out = []
            for conv, _, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = last is None or last[0] != conv or len(roles) == segment
                if last is not None:
                    out.append((*last, matrix() if new else None))
                if new:
                    part += 1
                    roles = []
                last = (conv, part, len(roles), own, text)
                roles.append(clean(own))
            if out:
                yield batch_of(out)
        if last is not None:
            yield batch_of([(*last, matrix())])

    order = ("conv_id", "turn", "role", "text")
    turns = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = common.stored(turns.mapInArrow(cut, "conv_id long, part long, place int, role string, text string, m array<double>"), "turns")
    costs = turns.where("m is not null").select("conv_id", "part", "m")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, *_), (_, parts, ms) in runs(batches, 1):
            chosen = between([np.array(m).reshape(4, 4) for m in ms])
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * n), pa.array(parts), pa.array(range(n), pa.int64()), pa.array([n] * n), pa.array(chosen[:-1], pa.int32()), pa.array(chosen[1:], pa.int32())], names=["conv_id", "part", "segment", "n_segments", "before", "after"])

    chosen = common.stored(costs.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(states, "conv_id long, part long, segment long, n_segments long, before int, after int"), "states")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in blocks(runs(batches)):
            out = []
            for (conv, _), (_, _, _, roles, texts, segments, sizes, before, after) in group:
                last = segments[0] == sizes[0] - 1
                cost, done = repair([clean(r) for r in roles], before[0], after[0])
                text, opened = render(texts, done, segments[0] > 0, last, before[0])
                end = closing(after[0]) if last else 0.0
                changed = sum(what != "keep" or bool(way) for _, what, way in done) + (end > 0)
                out.append((conv, segments[0], sizes[0], len(texts), cost + end, int(changed), opened, text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "segment", "n_segments", "n_turns", "cost", "n_changed", "roles", "rendered"])

    schema = "conv_id long, segment long, n_segments long, n_turns long, cost double, n_changed long, roles array<string>, rendered string"
    whole = turns.join(chosen, ["conv_id", "part"]).select("conv_id", "part", "place", "role", "text", "segment", "n_segments", "before", "after")
    return whole.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").mapInArrow(finish, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: int = 2) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns) of each run of rows with equal first columns, over batches sorted by them."""
    held: list[list] = []
    key: tuple = ()
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        each = list(zip(*columns[:keys], strict=True))
        begin = 0
        for i in range(1, len(each) + 1):
            if i < len(each) and each[i] == each[begin]:
                continue
            piece = [c[begin:i] for c in columns]
            if held and key == each[begin]:
                for a, b in zip(held, piece, strict=True):
                    a += b
            else:
                if held:
                    yield key, held
                held, key = piece, each[begin]
            begin = i
    if held:
        yield key, held


def blocks(items: Iterable, size: int = 500) -> Iterator[list]:
    """Lists of up to ``size`` items."""
    it = iter(items)
    while block := list(islice(it, size)):
        yield block
