"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

A legal chat is an optional system turn, then user and assistant turns in alternation, user first. Each
given turn is kept, relabelled, or merged into the turn before it, and empty turns may be put in front
of it; every change has a price and the cheapest repair of the whole conversation is taken.

The price of a stretch of turns is a small matrix: from each automaton state into each. Such matrices
compose by (min, +), in order and in any grouping. So turns are dealt out in ranges of (conversation,
turn), a conversation of any length spreads over several tasks, and only one matrix for the first and
the last conversation of each range, bounded by the number of ranges, is combined on the driver. Then
every range knows in which state it begins and ends and repairs its own turns.

The result has one row per given turn with the piece of rendered text it adds; the pieces of a
conversation in ascending ``position`` are its rendering, so no conversation is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.sources.folders import shared_folder

from .common import map_partition

# States of the automaton, the role each stands for, and the legal moves.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
MOVES = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = (USER, ASSISTANT, START)  # an empty conversation is legal; one of a system turn alone is not

NEVER = 10**9


@dataclass(frozen=True)
class Prices:
    merge: int = 2  # a turn goes on with the turn before it
    relabel: int = 3  # a known role is changed
    unknown: int = 1  # a missing or unknown role is filled in
    insert: int = 4  # an empty turn is put in front
    close: int = 4  # an empty user turn at the end, for a conversation of a system turn alone


@dataclass(frozen=True)
class Step:
    """One way to take a turn: price, action, empty turns in front, state afterwards."""

    price: int
    action: str
    inserted: tuple[int, ...]
    state: int


def _paths(state: int, most: int = 3) -> list[tuple[int, ...]]:
    """Legal runs of up to ``most`` turns from a state."""
    paths = [(s,) for s in MOVES[state]]
    for _ in range(most - 1):
        paths += [p + (s,) for p in paths for s in MOVES[p[-1]] if len(p) < most]
    return sorted(set(paths), key=lambda p: (len(p), p))


def steps_from(role: str, prices: Prices) -> dict[tuple[int, int], Step]:
    """(state before, state after) -> cheapest step for a turn with this role; the first listed wins a tie."""
    known = role in ROLES[1:]
    best: dict[tuple[int, int], Step] = {}
    for state in range(4):
        found = []
        for path in _paths(state):
            label = 0 if ROLES[path[-1]] == role else prices.relabel if known else prices.unknown
            found.append(Step(label + prices.insert * (len(path) - 1), "keep" if not label else "relabel", path[:-1], path[-1]))
        if state != START:
            label = 0 if ROLES[state] == role else prices.relabel if known else prices.unknown
            found.append(Step(prices.merge + label, "merge" if not label else "merge_relabel", (), state))
        for step in found:
            key = (state, step.state)
            if key not in best or step.price < best[key].price:
                best[key] = step
    return best


class Repair:
    """Matrices and steps of all roles."""

    def __init__(self, prices: Prices = Prices()):
        self.prices = prices
        self.by_role = {role: steps_from(role, prices) for role in (*ROLES[1:], "?")}
        self.matrix = {role: np.array([[steps[i, j].price if (i, j) in steps else NEVER for j in range(4)] for i in range(4)], np.int64)
                       for role, steps in self.by_role.items()}

    @staticmethod
    def role(given: str | None) -> str:
        name = (given or "").strip().lower()
        return name if name in ROLES[1:] else "?"

    def end_price(self, state: int) -> int:
        return 0 if state in FINAL else self.prices.close

    def total(self, roles: list[str]) -> np.ndarray:
        """The matrix of a stretch of turns."""
        out = np.where(np.eye(4, dtype=bool), 0, NEVER)
        for role in roles:
            out = np.minimum((out[:, :, None] + self.matrix[role][None]).min(axis=1), NEVER)
        return out

    def best(self, roles: list[str], begin: int, end: int | None) -> list[Step]:
        """Cheapest steps from state ``begin`` to ``end`` (None: the best legal end); ties go to the lower states."""
        cost, back = [NEVER if s != begin else 0 for s in range(4)], []
        for role in roles:
            steps, new, came = self.by_role[role], [NEVER] * 4, [-1] * 4
            for (i, j), step in steps.items():
                if cost[i] + step.price < new[j]:
                    new[j], came[j] = cost[i] + step.price, i
            back.append(came)
            cost = new
        state = end if end is not None else min(range(4), key=lambda s: (cost[s] + self.end_price(s), s))
        found = []
        for role, came in zip(reversed(roles), reversed(back)):
            found.append(self.by_role[role][came[state], state])
            state = came[state]
        return found[::-1]


def open_turn(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSE = "<|end|>\n"


def render(step: Step, text: str, first: bool, last: bool) -> str:
    """What a turn adds to the rendering. A turn is closed by the one after it, since that may go on with it."""
    if step.action.startswith("merge"):
        head = "\n"
    else:
        empty = "".join(open_turn(r) + CLOSE for r in step.inserted)
        head = ("" if first else CLOSE) + empty + open_turn(step.state)
    tail = CLOSE if last else ""
    if last and step.state == SYSTEM:
        tail += open_turn(USER) + CLOSE
    return head + text + tail


_SORTED = "conv_id bigint, turn bigint, role string, text string"
RANGE_TURNS = 100_000  # turns a range should hold, since a task holds one
SCHEMA = "conv_id bigint, turn bigint, position bigint, role string, new_role string, action string, inserted string, price bigint, rendered string"


def _runs(conv: list[int | None]) -> list[tuple[int, int]]:
    cuts = [i for i in range(len(conv)) if not i or conv[i] != conv[i - 1]]
    return list(zip(cuts, [*cuts[1:], len(conv)]))


def _ranges(df: DataFrame) -> DataFrame:
    """Turns in ranges of (conversation, turn), kept as they are cut: both passes must see the same ranges."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "chat"))
    order = ["conv_id", "turn", "tie"]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_TURNS))
    return (df.withColumn("tie", F.xxhash64("role", "text")).repartitionByRange(ranges, *order).sortWithinPartitions(*order, "role", "text")
            .select("conv_id", "turn", "role", "text").checkpoint())


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[list, list, list, list]:
    columns: tuple[list, list, list, list] = ([], [], [], [])
    for batch in batches:  # a task holds one range of turns
        for column, values in zip(columns, batch.columns):
            column += values.to_pylist()
    return columns


def _edges(turns: DataFrame, repair: Repair) -> dict[int, list[tuple[int | None, int, list[int]]]]:
    """Range -> (conversation, turns, matrix) of its first and its last conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        conv, _, role, _ = _read(batches)
        runs = _runs(conv)
        if runs:
            ends = [runs[0], runs[-1]] if len(runs) > 1 else runs
            yield {"range": [TaskContext.get().partitionId()] * len(ends), "conv_id": [conv[a] for a, _ in ends], "turns": [b - a for a, b in ends],
                   "matrix": [repair.total([repair.role(r) for r in role[a:b]]).ravel().tolist() for a, b in ends]}

    rows = map_partition(turns, run, "range int, conv_id bigint, turns bigint, matrix array<bigint>").collect()  # two small rows per range
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["range"], []).append((r["conv_id"], r["turns"], r["matrix"]))
    return found


def _plan(edges: dict[int, list], repair: Repair) -> dict[int, tuple[int, int, int | None, int | None]]:
    """Range -> state at its start, turns of that conversation before it, state at the end of its first and of its last run.

    A state is None where the run ends its conversation and may choose.
    """
    plan: dict[int, list] = {r: [START, 0, None, None] for r in edges}
    ranges = sorted(edges)
    chains: list[list[tuple[int, int]]] = []  # runs of one conversation over ranges: (range, which run)
    for at, r in enumerate(ranges):
        for k in range(len(edges[r])):
            before = ranges[at - 1] if at else None
            if k == 0 and before is not None and edges[before][-1][0] == edges[r][0][0]:
                chains[-1].append((r, 0))
            else:
                chains.append([(r, k)])
    for chain in chains:
        if len(chain) < 2:
            continue
        costs = [[0 if s == START else NEVER for s in range(4)]]
        came = []
        for r, k in chain:
            matrix = np.array(edges[r][k][2], np.int64).reshape(4, 4)
            total = np.array(costs[-1])[:, None] + matrix
            came.append(total.argmin(axis=0))
            costs.append(np.minimum(total.min(axis=0), NEVER).tolist())
        state: int | None = min(range(4), key=lambda s: (costs[-1][s] + repair.end_price(s), s))
        states = [state]
        for c in reversed(came):
            states.append(int(c[states[-1]]))
        states = states[::-1]
        before = 0
        for i, (r, k) in enumerate(chain):
            if i:
                plan[r][0], plan[r][1] = states[i], before
            if i < len(chain) - 1:
                plan[r][3] = states[i + 1]
                if len(edges[r]) == 1:
                    plan[r][2] = states[i + 1]
            before += edges[r][k][1]
    return {r: tuple(p) for r, p in plan.items()}


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 prices: Prices = Prices()) -> DataFrame:
    """One row per given turn: its place in the conversation, new role, action, price and rendered piece.

    Turns are ordered by number, nulls first, then by role and text; equal rows stand next to each other.
    A null conversation id is one conversation. Roles are compared without case and outer blanks; null or
    other roles are unknown and filled in. A null text is empty. ``inserted`` names the empty turns put in
    front; a conversation of system turns alone is closed with an empty user turn. An empty table gives
    no rows; other columns are not read.
    """
    repair = Repair(prices)
    base = turns.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
                        F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ranges = _ranges(base)
    plan = turns.sparkSession.sparkContext.broadcast(_plan(_edges(ranges, repair), repair))  # four numbers per range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
        conv, turn, role, text = _read(batches)
        if not conv:
            return
        begin, before, first_end, last_end = plan.value[TaskContext.get().partitionId()]
        runs = _runs(conv)
        for low in range(0, len(runs), 256):
            rows: dict[str, list] = {k: [] for k in ("conv_id", "turn", "position", "role", "new_role", "action", "inserted", "price", "rendered")}
            for number in range(low, min(low + 256, len(runs))):
                a, b = runs[number]
                end = last_end if number == len(runs) - 1 else first_end if number == 0 else None
                start, offset = (begin, before) if number == 0 else (START, 0)
                steps = repair.best([repair.role(r) for r in role[a:b]], start, end)
                for i, step in enumerate(steps):
                    last = i == b - a - 1 and end is None
                    values = (conv[a], turn[a + i], offset + i, role[a + i], ROLES[step.state], step.action, ",".join(ROLES[r] for r in step.inserted),
                              step.price + (repair.end_price(step.state) if last else 0), render(step, text[a + i] or "", offset + i == 0, last))
                    for column, value in zip(rows.values(), values):
                        column.append(value)
            yield rows

    return map_partition(ranges, run, SCHEMA)
