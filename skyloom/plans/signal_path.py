"""The signal path of a single-antenna receiver, and assemble(): operators in any order become one DataFrame.

Sources and transforms up to the digitiser are column expressions, so Catalyst sees one projection; what follows are grouped steps.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.errors import AmbiguousNodeError, PlanError
from skyloom.functions import dual
from skyloom.operators.base import Operator, Stage, Transform
from skyloom.operators.transforms import Snapshot
from skyloom.plans.graph import SignalGraph, register_graph

# Nodes of the path in order (kind; * allows several instances), and what each feeds.
NODES = {
    "global_signal": ("source", "astro_sum"),
    "foregrounds": ("source*", "astro_sum"),
    "point_sources": ("source", "astro_sum"),
    "uniform_sky": ("source", "astro_sum"),
    "astro_sum": ("sum", "ionosphere"),
    "ionosphere": ("transform", "atmosphere_field"),
    "atmosphere_field": ("transform", "field_sum"),
    "ground_field": ("source", "field_sum"),
    "rfi_field": ("source", "field_sum"),
    "field_sum": ("sum", "beam"),
    "beam": ("transform", "astro_ant_sum"),
    "observed_astro_sky": ("source", "astro_ant_sum"),
    "astro_ant_sum": ("sum", "beam_spill"),
    "beam_spill": ("transform", "t_ant_sum"),
    "ground_pickup": ("source", "t_ant_sum"),
    "t_sys_extra": ("source*", "t_ant_sum"),
    "atmosphere": ("source", "t_ant_sum"),
    "t_ant_sum": ("sum", "antenna_loss"),
    "antenna_loss": ("transform", "receiver_input"),
    "cal_loads": ("source*", "receiver_input"),
    "receiver_input": ("switch", "noise_wave"),
    "noise_wave": ("transform", "cw_tone"),
    "cw_tone": ("transform", "bandpass"),
    "bandpass": ("transform", "gain"),
    "gain": ("transform", "noise"),
    "noise": ("transform", "emi"),
    "emi": ("transform", "adc"),
    "adc": ("transform", "flagging"),
    "flagging": ("transform", "averaging"),
    "averaging": ("transform", "apply_cal"),
    "apply_cal": ("transform", "filters"),
    "filters": ("transform*", None),
}
PROCESSING = ("flagging", "averaging", "apply_cal", "filters")
RECEIVER = register_graph(SignalGraph("receiver", {n: kind for n, (kind, _) in NODES.items()}, tuple((n, to) for n, (_, to) in NODES.items() if to)))


@dataclass(frozen=True)
class At:
    """An operator at a node other than its own, or at a path of nodes that follow each other, in place of all of them."""

    place: str | tuple[str, ...]
    operator: Operator

    @property
    def path(self) -> tuple[str, ...]:
        return (self.place,) if isinstance(self.place, str) else tuple(self.place)

    @property
    def node(self) -> str:
        return self.path[0]


def add(branches: list[Column]) -> Column:
    """The junction: branches summed in order."""
    total = branches[0]
    for b in branches[1:]:
        total = total + b
    return total


def select(switch: Column, branches: list[Column]) -> Column:
    """The switch: branch i where it says i, and 0 where it says what no branch is."""
    out = F.lit(0.0)
    for i, b in reversed(list(enumerate(branches))):
        out = dual.either(switch == i, b, out)
    return out


@dataclass
class Assembly:
    placed: dict[str, list[Operator]]
    order: list[Operator | At] = field(default_factory=list)

    @property
    def lit(self) -> list[str]:
        return [n for n in NODES if n in self.placed]

    @property
    def skipped(self) -> list[str]:
        return [n for n, (kind, _) in NODES.items() if n not in self.placed and kind not in ("sum", "switch")]

    @property
    def sourced(self) -> bool:
        return any(NODES[n][0].startswith("source") for n in self.placed)

    def instances(self, node: str) -> list[Operator]:
        return list(self.placed.get(node, ()))

    def _branches(self, node: str) -> int:
        """Live branches that a node gives: a source as many as it has, others one if a source is anywhere before them."""
        kind = NODES[node][0]
        if kind.startswith("source"):
            return len(self.placed.get(node, ()))
        n = sum(self._branches(x) for x in RECEIVER.feeds(node))
        return min(n, 1)

    @property
    def materialized(self) -> list[str]:
        """Junctions and switches that more than one live branch meets."""
        return [n for n, (kind, _) in NODES.items() if kind in ("sum", "switch") and sum(map(self._branches, RECEIVER.feeds(n))) > 1]

    @property
    def aliased(self) -> dict[str, str]:
        """Junctions and switches that a single branch passes, and whose it is."""
        out = {}
        for n, (kind, _) in NODES.items():
            live = [x for x in RECEIVER.feeds(n) for _ in range(self._branches(x))] if kind in ("sum", "switch") else []
            if len(live) == 1:
                out[n] = live[0]
        return out

    def __getitem__(self, node: str) -> Operator:
        ops = self.placed.get(node) or []
        if not ops:
            raise PlanError(f"nothing stands at {node}")
        if len(ops) > 1:
            raise AmbiguousNodeError(f"{len(ops)} operators stand at {node}")
        return ops[0]

    def without(self, node: str) -> Assembly:
        self[node]
        return assemble(*(o for o in self.order if _node(o) != node))

    def replace_node(self, node: str, operator: Operator) -> Assembly:
        self[node]
        return assemble(*(At(node, operator) if _node(o) == node else o for o in self.order))

    def replace_field(self, node: str, index: int, name: str, value) -> Assembly:
        """The same plan with one field of one operator changed."""
        found = self.instances(node)
        if not 0 <= index < len(found) or name not in found[index].params + tuple(f.name for f in dataclasses.fields(found[index])):
            raise PlanError(f"no field {node}[{index}].{name}")
        new, seen, order = dataclasses.replace(found[index], **{name: value}), 0, []
        for o in self.order:
            if _node(o) == node:
                order.append((At(o.place, new) if isinstance(o, At) else new) if seen == index else o)
                seen += 1
            else:
                order.append(o)
        return assemble(*order)

    def expression(self, cells: DataFrame, until: str = "adc") -> tuple[DataFrame, Column, dict[str, Column]]:
        """cells with what the operators up to `until` read, the signal there as a column of them, and the snapshots on the way."""
        params: dict[int, dict[str, Column]] = {}
        for i, (node, op) in enumerate((n, o) for n in NODES for o in self.placed.get(n, ())):
            if not isinstance(op, Stage):
                cells, params[id(op)] = op.attach(cells, f"{i}_{node}")
        # where a parameter moves (see functions.dual), all columns that operators compute with are duals
        moving = any(isinstance(c, dual.Dual) for p in params.values() for c in p.values())
        lift = dual.lift if moving else lambda x: x
        for op in (o for some in self.placed.values() for o in some if id(o) in params):
            params[id(op)] |= {n: lift(params[id(op)][n]) for n in op.params if n in params[id(op)]}
        snaps: dict[str, Column] = {}

        def through(node: str, x: Column | None) -> Column | None:
            for op in self.placed.get(node, ()):
                if x is None:
                    raise PlanError(f"no signal reaches {node}")
                x = lift(op.column(x, params[id(op)]))
                if isinstance(op, Snapshot):
                    snaps[op.name] = x
            return x

        def value(node: str) -> list[Column]:
            kind = NODES[node][0]
            if kind.startswith("source"):
                return [lift(op.column(params[id(op)])) for op in self.placed.get(node, ())]
            branches = [b for n in RECEIVER.feeds(node) for b in value(n)]
            if not branches:
                return []
            if kind == "sum":
                return [add(branches)]
            if kind == "switch":
                return [branches[0] if len(branches) == 1 else select(F.col("receiver_input"), branches)]
            return [through(node, branches[0])]

        if self.sourced:
            return cells, value(until)[0], snaps
        data = lift(F.col("data"))
        trunk = [n for n, (kind, _) in NODES.items() if kind == "transform" and n not in PROCESSING]
        for n in trunk[: trunk.index(until) + 1]:
            data = through(n, data)
        return cells, data, snaps

    def __call__(self, cells: DataFrame, until: str | None = None) -> DataFrame:
        """cells needs recording_id, time_idx, freq_idx, time_s, freq_hz, and t_ambient or receiver_input where operators read them.

        With a source in the plan `data` is made; without one it is what the transforms work on. until: the last node to apply.
        """
        if self.sourced and "data" in cells.columns:
            raise PlanError("a plan with sources makes its own data")
        if not self.sourced and "data" not in cells.columns:
            raise PlanError("a plan without sources needs data")
        keep = [c for c in cells.columns if c != "data"]
        early = until is not None and until not in PROCESSING and NODES[until][0] == "transform"
        wide, data, snaps = self.expression(cells, until if early else "adc")
        out = wide.select(*keep, data.alias("data"), *(c.alias(f"snap_{n}") for n, c in snaps.items()))
        if early:
            return out
        for n in PROCESSING:
            for op in self.placed.get(n, ()):
                out = op(out)
            if n == until:
                break
        return out

    def to_mermaid(self) -> str:
        return RECEIVER.to_mermaid(set(self.lit))

    def to_html(self) -> str:
        return RECEIVER.to_html(set(self.lit))


def _node(o: Operator | At) -> str | None:
    return o.node


def assemble(*operators: Operator | At) -> Assembly:
    """Place operators on the path: in any order, each at its own node or where At says. Refuses what has no place, or too many there."""
    placed: dict[str, list[Operator]] = {}
    taken: dict[str, str] = {}
    for o in operators:
        op = o.operator if isinstance(o, At) else o
        path = o.path if isinstance(o, At) else (o.node,)
        node = path[0]
        if node not in NODES:
            raise PlanError(f"{type(op).__name__} has no node of its own; place it with At" if node is None else f"no node {node}")
        for a, b in zip(path, path[1:]):
            if (a, b) not in RECEIVER.edges:
                raise PlanError(f"{b} doesn't follow {a}")
        kind = NODES[node][0]
        if any(op.kind != NODES[n][0].rstrip("*") for n in path):
            raise PlanError(f"{node} takes a {kind.rstrip('*')}, not {type(op).__name__}")
        if isinstance(op, Stage) != (node in PROCESSING) and not isinstance(op, Transform):
            raise PlanError(f"{type(op).__name__} can't stand at {node}")
        placed.setdefault(node, []).append(op)
        if len(placed[node]) > 1 and not kind.endswith("*"):
            raise PlanError(f"{node} takes one operator")
        for n in path[1:]:
            taken[n] = type(op).__name__
        late = [p for p in op.precedes if list(NODES).index(node) >= list(NODES).index(p)]
        if late:
            raise PlanError(f"{type(op).__name__} must stand before {late}")
    if both := sorted(set(taken) & set(placed)):
        raise PlanError(f"{taken[both[0]]} already stands for {both}")
    if not placed:
        raise PlanError("a plan needs an operator")
    return Assembly(placed, list(operators))


class Pipeline:
    """Steps in turn, by name. A step is a stage or any function of a DataFrame; names that repeat are numbered."""

    def __init__(self, *steps: Callable[[DataFrame], DataFrame], names: list[str] | None = None):
        if not steps:
            raise PlanError("a pipeline needs a step")
        plain = list(names) if names is not None else [getattr(s, "node", None) or getattr(s, "__name__", type(s).__name__) for s in steps]
        if len(plain) != len(steps) or (names is not None and len(set(plain)) < len(plain)):
            raise PlanError("a name for each step, and each its own")
        seen: dict[str, int] = {}
        self.names = []
        for n in plain:
            seen[n] = seen.get(n, 0) + 1
            self.names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
        self.steps = list(steps)
        for i, s in enumerate(steps):
            if late := [t.node for t in steps[:i] if getattr(t, "node", None) in getattr(s, "precedes", ())]:
                raise PlanError(f"{type(s).__name__} must stand before {late}")

    def __len__(self) -> int:
        return len(self.steps)

    def __iter__(self):
        return iter(self.steps)

    def __getitem__(self, name: str | int):
        return self.steps[name if isinstance(name, int) else self._index(name)]

    def _index(self, name: str) -> int:
        if name not in self.names:
            raise PlanError(f"no step {name}")
        return self.names.index(name)

    def replace_stage(self, name: str, step: Callable[[DataFrame], DataFrame]) -> Pipeline:
        i = self._index(name)
        return Pipeline(*self.steps[:i], step, *self.steps[i + 1 :], names=self.names)

    def run_with_intermediates(self, cells: DataFrame) -> list[DataFrame]:
        """The table after each step, lazily, so that those not used cost nothing."""
        out = []
        for step in self.steps:
            cells = step(cells)
            out.append(cells)
        return out

    def __call__(self, cells: DataFrame) -> DataFrame:
        return self.run_with_intermediates(cells)[-1]


def stages_requiring_seed(plan: Assembly | Pipeline) -> list[str]:
    """Names of the operators that draw random numbers."""
    named = [(n, o) for n in plan.placed for o in plan.placed[n]] if isinstance(plan, Assembly) else zip(plan.names, plan.steps)
    return [n for n, o in named if getattr(o, "random", False)]
