"""Graphs of named steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError as _Cycle
from graphlib import TopologicalSorter
from typing import Any


class CycleError(ValueError):
    """The steps depend on each other in a circle."""


@dataclass
class Step:
    """operation gets a Context and gives a frame; that of an action step gives anything, and does its work when called."""

    id: str
    operation: Callable[[Context], Any]
    action: bool = False
    retries: int = 3
    timeout: float | None = None
    config: dict[str, Any] = field(default_factory=dict)


@dataclass
class Context:
    """What a step sees: its own config, and the results of the steps it depends on, in the order of the edges."""

    step: str
    config: dict[str, Any]
    results: dict[str, Any]
    dependencies: list[str]

    @property
    def inputs(self) -> list[Any]:
        return [self.results[d] for d in self.dependencies]


class Graph:
    """Steps and the edges between them."""

    def __init__(self, name: str = "pipeline"):
        self.name = name
        self._steps: dict[str, Step] = {}
        self._edges: list[tuple[str, str]] = []

    def add_node(self, step: Step) -> Graph:
        if step.id in self._steps:
            raise ValueError(f"there is a step {step.id!r} already")
        self._steps[step.id] = step
        return self

    def add_edge(self, upstream: str, downstream: str) -> Graph:
        for s in (upstream, downstream):
            if s not in self._steps:
                raise KeyError(f"no step {s!r}")
        if upstream == downstream:
            raise ValueError(f"{upstream!r} can't depend on itself")
        if (upstream, downstream) in self._edges:
            raise ValueError(f"there is an edge from {upstream!r} to {downstream!r} already")
        self._edges.append((upstream, downstream))
        return self

    @property
    def nodes(self) -> dict[str, Step]:
        return dict(self._steps)

    @property
    def edges(self) -> list[tuple[str, str]]:
        return list(self._edges)

    def dependencies(self, step: str) -> list[str]:
        return [a for a, b in self._edges if b == step]

    def dependents(self, step: str) -> list[str]:
        return [b for a, b in self._edges if a == step]

    def roots(self) -> list[str]:
        return sorted(s for s in self._steps if not self.dependencies(s))

    def order(self) -> list[str]:
        """Steps after all that they depend on; those that are ready together by name."""
        sorter = TopologicalSorter({s: self.dependencies(s) for s in self._steps})
        try:
            sorter.prepare()
        except _Cycle as e:
            raise CycleError(f"a circle: {' -> '.join(e.args[1])}") from e
        out: list[str] = []
        ready: list[str] = []
        while sorter.is_active():
            ready = sorted([*ready, *sorter.get_ready()])
            out.append(ready.pop(0))
            sorter.done(out[-1])
        return out

    def validate(self) -> list[str]:
        """Warnings; what can't run is an error."""
        if not self._steps:
            raise ValueError("no steps")
        self.order()
        tied = {s for e in self._edges for s in e}
        return [f"step {s!r} is connected to nothing" for s in sorted(self._steps) if len(self._steps) > 1 and s not in tied]
