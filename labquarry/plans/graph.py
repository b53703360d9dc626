"""Operator graphs: a declarative description of nodes and their inputs becomes one lazy Spark plan.

A graph is {node: {"op": name or callable, "inputs": [...], "params": {...}}}. An input names a node, or node.branch for
operators with several results, or a table given to run(). Nodes that several others read are cached only on request.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from ..operators import advanced, evaluation, figures, images, models, molecules, neighbours, screening, shapes, statistics, tabular, tracking


class GraphError(ValueError):
    """The graph has a cycle, an unknown operator or input, or a node that fails; the message names the node."""


def operators() -> dict[str, Callable]:
    """All operators by module.name."""
    found = {}
    for module in (tabular, statistics, advanced, evaluation, tracking, neighbours, models, images, shapes, molecules, screening, figures):
        short = module.__name__.rpartition(".")[2]
        for name, f in vars(module).items():
            if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == module.__name__:
                found[f"{short}.{name}"] = f
    return found


def order(graph: dict[str, dict], tables: set[str]) -> list[str]:
    """Nodes, each after its inputs."""
    out: list[str] = []
    state: dict[str, int] = {}

    def visit(node: str, path: tuple[str, ...]) -> None:
        if state.get(node) == 2:
            return
        if state.get(node) == 1:
            raise GraphError(f"cycle: {' -> '.join([*path, node])}")
        state[node] = 1
        for source in graph[node].get("inputs", []):
            name = source.partition(".")[0]
            if name in graph:
                visit(name, (*path, node))
            elif name not in tables:
                raise GraphError(f"{node}: no input {source!r}")
        state[node] = 2
        out.append(node)

    for node in graph:
        visit(node, ())
    return out


def run(graph: dict[str, dict], tables: dict[str, DataFrame], cache_shared: bool = False) -> dict[str, Any]:
    """The result of each node, lazily: nothing is computed until a result is read."""
    known, results = operators(), dict(tables)
    readers: dict[str, int] = {}
    for node in graph.values():
        for source in node.get("inputs", []):
            readers[source.partition(".")[0]] = readers.get(source.partition(".")[0], 0) + 1
    for name in order(graph, set(tables)):
        node = graph[name]
        f = node["op"] if callable(node["op"]) else known.get(node["op"])
        if f is None:
            raise GraphError(f"{name}: no operator {node['op']!r}")
        inputs = []
        for source in node.get("inputs", []):
            base, _, branch = source.partition(".")
            value = results[base]
            if branch:
                if not isinstance(value, dict) or branch not in value:
                    raise GraphError(f"{name}: no branch {source!r}")
                value = value[branch]
            inputs.append(value)
        try:
            value = f(*inputs, **node.get("params", {}))
        except Exception as error:
            raise GraphError(f"{name}: {error}") from error
        if cache_shared and isinstance(value, DataFrame) and readers.get(name, 0) > 1:
            value = value.cache()
        results[name] = value
    return {k: v for k, v in results.items() if k in graph}
