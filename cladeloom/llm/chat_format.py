"""Role repair of conversations at the smallest cost, and their rendering.

A legal conversation may begin with a system turn, then user and assistant turns alternate, and an assistant turn is the
last. The automaton's state is the role of the last turn. A turn of the input either becomes a new turn, as it is or
relabelled, after as many empty turns as the automaton needs; or it is merged into the turn before. Every
input role thus has one matrix of costs from state to state, and a stretch of turns has the (min, +) product of
its matrices, so a conversation needn't be in one place:

1. turns are dealt by ranges of (conversation, turn), so one with very many turns spreads over several ranges; each
   range yields the product of every conversation in it;
2. the products of a conversation, one row per range, give the states at the borders of its ranges;
3. each range repeats the dynamic programme between its two border states and reads off the choices.

Costs tie towards a new turn before a merge, and towards the role that comes first in ``system, user, assistant``.

The result has a row per input turn: the repaired role, what was done, the empty turns in front, and its part of the
rendered text. The parts of a conversation in order are its rendering. Turns with equal numbers are ordered by
role and text. Unknown and NULL roles have to be relabelled. A NULL text is empty; a NULL turn number comes first; rows with a
NULL conversation are left out. Repeated rows are turns of their own. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

ROLES = ("system", "user", "assistant")
START = 3  # state before the first turn; states 0-2 are the role of the last turn
#: Roles that may follow each state, and roles that may be the last.
FOLLOWS = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
LAST = (2,)
UNKNOWN = 3  # an input role that is none of ROLES


@dataclass(frozen=True)
class Costs:
    merge: float = 1.0
    relabel: float = 2.0
    insert: float = 2.0


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    joint: str = "\n\n"  # between merged texts

    def text(self, value: str) -> str:
        """A text can't open or close a turn of its own."""
        return value.replace("<|", "<​|")


def _fewest(start: int, goal) -> tuple[int, ...]:
    """Shortest legal sequence of empty turns from ``start`` to a state that satisfies ``goal``."""
    reached, seen = [(start, ())], {start}
    for state, path in reached:
        if goal(state):
            return path
        for role in FOLLOWS[state]:
            if role not in seen:
                seen.add(role)
                reached.append((role, (*path, role)))
    return (-1,)


class Automaton:
    def __init__(self, costs: Costs):
        self.empty = {(s, x): _fewest(s, lambda t, x=x: x in FOLLOWS[t]) for s in range(4) for x in range(3)}
        self.finish = {s: _fewest(s, lambda t: t in LAST) for s in range(4)}
        self.end = np.array([len(self.finish[s]) * costs.insert for s in range(4)])
        self.matrix = np.full((4, 4, 4), np.inf)  # input role, state before, state after
        self.merged = np.zeros((4, 4, 4), bool)
        for role in range(4):
            for s in range(4):
                for x in range(3):
                    path = self.empty[s, x]
                    if path != (-1,):
                        self.matrix[role, s, x] = len(path) * costs.insert + (x != role) * costs.relabel
                if s != START:
                    cost = costs.merge + (s != role) * costs.relabel
                    if cost < self.matrix[role, s, s]:
                        self.matrix[role, s, s], self.merged[role, s, s] = cost, True

    def product(self, roles: np.ndarray) -> np.ndarray:
        total = np.full((4, 4), np.inf)
        np.fill_diagonal(total, 0.0)
        for role in roles:
            total = (total[:, :, None] + self.matrix[role][None, :, :]).min(axis=1)
        return total

    def path(self, roles: np.ndarray, first: int, last: int) -> list[int]:
        """States after each turn on the cheapest way from ``first`` to ``last``."""
        cost = np.full(4, np.inf)
        cost[first] = 0.0
        back = np.empty((len(roles), 4), np.int8)
        for i, role in enumerate(roles):
            step = cost[:, None] + self.matrix[role]
            back[i] = step.argmin(axis=0)
            cost = step.min(axis=0)
        states = [last]
        for i in range(len(roles) - 1, 0, -1):
            states.append(int(back[i][states[-1]]))
        return states[::-1]


def role_numbers(roles: list[str | None]) -> np.ndarray:
    known = {r: i for i, r in enumerate(ROLES)}
    return np.array([known.get(r, UNKNOWN) for r in roles], np.int8)


def _cut_pairs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Stretches in which neither column changes."""
    if not len(a):
        return []
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return list(zip(starts.tolist(), np.append(starts[1:], len(a)).tolist(), strict=True))


PRODUCT = "conv_id bigint, part int, product array<double>"


def _products(costs: Costs):
    """The product of each conversation in a sorted range, carried over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(costs)
        last: tuple[int, int, np.ndarray] | None = None
        for batch in batches:
            conv, parts, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy(), role_numbers(batch.column(2).to_pylist())
            done = []
            for a, b in _cut_pairs(conv, parts):
                product = machine.product(roles[a:b])
                if last is not None and last[:2] == (conv[a], parts[a]):
                    product = (last[2][:, :, None] + product[None, :, :]).min(axis=1)
                elif last is not None:
                    done.append(last)
                last = (int(conv[a]), int(parts[a]), product)
            yield _product_rows(done)
        yield _product_rows([last] if last is not None else [])

    return run


def _product_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].ravel().tolist() for r in rows], pa.list_(pa.float64()))],
        names=["conv_id", "part", "product"],
    )


BORDER = "conv_id bigint, part int, first int, last int, opens boolean, closes boolean"


def _borders(costs: Costs):
    """States at the borders of the ranges of each conversation, from the products in order."""

    def solve(machine: Automaton, conv: int, rows: list[tuple[int, np.ndarray]]) -> list[tuple]:
        cost = np.full(4, np.inf)
        cost[START] = 0.0
        back = []
        for _, product in rows:
            step = cost[:, None] + product
            back.append(step.argmin(axis=0))
            cost = step.min(axis=0)
        state = int((cost + machine.end).argmin())
        out = []
        for i in range(len(rows) - 1, -1, -1):
            before = int(back[i][state])
            out.append((conv, rows[i][0], before, state, i == 0, i == len(rows) - 1))
            state = before
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(costs)
        conv, held = None, []
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in BORDER.split(", ")])

        for batch in batches:
            out = []
            for c, part, product in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv and held:
                    out += solve(machine, conv, held)
                    held = []
                conv = c
                held.append((part, np.array(product).reshape(4, 4)))
            yield rows(out)
        yield rows(solve(machine, conv, held) if held else [])

    return run


REPAIRED = "conv_id bigint, turn bigint, role string, repaired_role string, action string, empty_before int, empty_after int, rendered string"


def _repair(costs: Costs, template: Template):
    def one(machine: Automaton, rows: dict[str, list]) -> Iterator[tuple]:
        roles = role_numbers(rows["role"])
        first, last, opens, closes = (rows[c][0] for c in ("first", "last", "opens", "closes"))
        states = machine.path(roles, first, last)
        before = first
        for i, (role, state) in enumerate(zip(roles, states, strict=True)):
            text = template.text(rows["text"][i] or "")
            merged = bool(machine.merged[role, before, state])
            empty = () if merged else machine.empty[before, state]
            action = ("merge" if merged else "keep") if role == state else ("relabel and merge" if merged else "relabel")
            if merged:
                part = template.joint + text
            else:
                part = "" if opens and i == 0 else template.closing
                part += "".join(template.opening.format(role=ROLES[r]) + template.closing for r in empty)
                part += template.opening.format(role=ROLES[state]) + text
            after = ()
            if closes and i == len(roles) - 1:
                after = machine.finish[state]
                part += template.closing + "".join(template.opening.format(role=ROLES[r]) + template.closing for r in after)
            yield rows["conv_id"][i], rows["turn"][i], rows["role"][i], ROLES[state], action, len(empty), len(after), part
            before = state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(costs)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        held: dict[str, list] | None = None

        def rows(found: Iterator[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in REPAIRED.split(", ")])

        for batch in batches:
            columns = batch.to_pydict()
            out: list[tuple] = []
            for a, b in _cut_pairs(batch.column(0).to_numpy(), batch.column(1).to_numpy()):
                part = {c: v[a:b] for c, v in columns.items()}
                if held and (held["conv_id"][0], held["part"][0]) == (part["conv_id"][0], part["part"][0]):
                    for c in held:
                        held[c] += part[c]
                    continue
                if held:
                    out += one(machine, held)
                held = part
            yield rows(iter(out))
        yield rows(one(machine, held) if held else iter(()))

    return run


def repair(turns: DataFrame, costs: Costs | None = None, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn of ``turns`` repaired and rendered (:data:`REPAIRED`)."""
    costs, template = costs or Costs(), template or Template()
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    ).where("conv_id IS NOT NULL")
    order = ["turn", "role", "text"]
    dealt = rows.repartitionByRange(partitions(turns.sparkSession), "conv_id", *order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "turns")
    ranged = dealt.repartition(partitions(turns.sparkSession), "part").sortWithinPartitions("part", "conv_id", *order)
    products = ranged.select("conv_id", "part", "role").mapInArrow(_products(costs), PRODUCT)
    joined = products.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    borders = stored(joined.mapInArrow(_borders(costs), BORDER), "borders")
    told = dealt.join(borders, ["conv_id", "part"]).repartition(partitions(turns.sparkSession), "conv_id", "part").sortWithinPartitions("conv_id", "part", *order)
    return told.select("conv_id", "part", "turn", "role", "text", "first", "last", "opens", "closes").mapInArrow(_repair(costs, template), REPAIRED)
