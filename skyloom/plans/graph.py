"""Templates of a signal path: nodes, what feeds what, and how a plan looks on it."""

from __future__ import annotations

import html
from dataclasses import dataclass

from skyloom.errors import PlanError

KINDS = ("source", "source*", "transform", "transform*", "sum", "switch")


@dataclass(frozen=True)
class SignalGraph:
    """nodes: name to kind (source, transform, sum, switch; * allows several instances); edges: (from, to). One sink, no cycle."""

    name: str
    nodes: dict[str, str]
    edges: tuple[tuple[str, str], ...]

    def __post_init__(self):
        if len(set(self.edges)) < len(self.edges):
            raise PlanError("an edge stands twice")
        if unknown := {n for e in self.edges for n in e} - set(self.nodes):
            raise PlanError(f"edges of no node: {sorted(unknown)}")
        if bad := [n for n, k in self.nodes.items() if k not in KINDS]:
            raise PlanError(f"nodes of no kind: {bad}")
        if len(sinks := [n for n in self.nodes if not self.follows(n)]) != 1:
            raise PlanError(f"a path has one end, not {sinks}")
        for n, kind in self.nodes.items():
            k = len(self.feeds(n))
            if kind.startswith("source") and k or kind.startswith("transform") and k > 1 or kind in ("sum", "switch") and k < 2:
                raise PlanError(f"{n}, a {kind}, is fed by {k}")
        self.order()

    def feeds(self, node: str) -> list[str]:
        return [a for a, b in self.edges if b == node]

    def follows(self, node: str) -> list[str]:
        return [b for a, b in self.edges if a == node]

    def order(self) -> list[str]:
        """Nodes, each after what feeds it; otherwise as declared."""
        out: list[str] = []
        left = dict.fromkeys(self.nodes)
        while left:
            ready = next((n for n in left if all(f in out for f in self.feeds(n))), None)
            if ready is None:
                raise PlanError(f"a cycle among {list(left)}")
            out.append(ready)
            del left[ready]
        return out

    def to_mermaid(self, lit: set[str] = frozenset()) -> str:
        shape = {"source": ("([", "])"), "transform": ("[", "]"), "sum": ("((", "))"), "switch": ("{", "}")}
        lines = ["flowchart LR"]
        for n, kind in self.nodes.items():
            a, z = shape[kind.rstrip("*")]
            lines.append(f"  {n}{a}{n}{z}" + (":::lit" if n in lit else ""))
        lines += [f"  {a} --> {b}" for a, b in self.edges]
        return "\n".join([*lines, "  classDef lit fill:#cde,stroke:#246"])

    def to_svg(self, lit: set[str] = frozenset()) -> str:
        """Columns by distance from the sources, a box for each node."""
        depth: dict[str, int] = {}
        for n in self.order():
            depth[n] = 1 + max((depth[f] for f in self.feeds(n)), default=-1)
        rows: dict[int, int] = {}
        at = {}
        for n, d in depth.items():
            at[n] = (20 + 150 * d, 20 + 40 * rows.get(d, 0))
            rows[d] = rows.get(d, 0) + 1
        width, height = 170 + 150 * max(rows), 40 + 40 * max(rows.values())
        parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">']
        for a, b in self.edges:
            (x, y), (u, v) = at[a], at[b]
            parts.append(f'<line x1="{x + 130}" y1="{y + 13}" x2="{u}" y2="{v + 13}" stroke="#888"/>')
        for n, (x, y) in at.items():
            fill = "#cde" if n in lit else "#fff"
            parts.append(f'<rect x="{x}" y="{y}" width="130" height="26" fill="{fill}" stroke="#246"/><text x="{x + 6}" y="{y + 17}">{html.escape(n)}</text>')
        return "".join([*parts, "</svg>"])

    def to_html(self, lit: set[str] = frozenset()) -> str:
        return f"<!doctype html><title>{html.escape(self.name)}</title><h1>{html.escape(self.name)}</h1>{self.to_svg(lit)}"


_GRAPHS: dict[str, SignalGraph] = {}


def register_graph(graph: SignalGraph) -> SignalGraph:
    if graph.name in _GRAPHS and _GRAPHS[graph.name] != graph:
        raise PlanError(f"another graph is named {graph.name}")
    _GRAPHS[graph.name] = graph
    return graph


def get_graph(name: str) -> SignalGraph:
    if name not in _GRAPHS:
        raise PlanError(f"no graph {name}; there are {sorted(_GRAPHS)}")
    return _GRAPHS[name]
