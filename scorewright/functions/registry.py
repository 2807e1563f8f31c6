"""Plug-in points: metrics as column functions, tools as Python data sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Metric:
    """A scoring function with what the tables need to know of it."""

    name: str
    score: Callable[..., Column]
    lower_is_better: bool
    perfect_value: float
    version: str = "1"
    needs_source_graph: bool = False
    needs_decompiled_graph: bool = False


_METRICS: dict[str, Metric] = {}
_TOOLS: dict[str, Callable] = {}


def register_metric(metric: Metric) -> Metric:
    if metric.name in _METRICS:
        raise ValueError(f"metric {metric.name!r} is registered")
    _METRICS[metric.name] = metric
    return metric


def metric(name: str) -> Metric:
    return _METRICS[name]


def metrics() -> list[str]:
    return sorted(_METRICS)


def register_tool(name: str):
    """Decorator: a function (binary path, version) -> rows (function, addr, code), run on the executors."""

    def add(f: Callable) -> Callable:
        _TOOLS[name] = f
        return f

    return add


def tool(spec: str) -> tuple[Callable, str | None]:
    """The tool and version of ``name`` or ``name@version``."""
    name, _, version = spec.partition("@")
    if name not in _TOOLS:
        raise KeyError(f"no tool {name!r}; known are {sorted(_TOOLS)}")
    return _TOOLS[name], version or None


def decompile(binaries, spec: str):
    """Rows of a tool over binaries (path): failures give one row with status and no function. A binary is a task's unit."""
    from collections.abc import Iterator

    import pandas as pd

    run_tool, version = tool(spec)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                try:
                    rows = [(path, spec, f, a, c, "ok") for f, a, c in run_tool(path, version)]
                except Exception as e:  # a tool's failure is a result
                    rows = [(path, spec, None, None, None, f"error: {e}"[:200])]
                yield pd.DataFrame(rows, columns=["path", "dec", "function_name", "addr", "code", "status"]).astype({"addr": "Int64"})

    return binaries.select("path").mapInPandas(run, "path string, dec string, function_name string, addr long, code string, status string")


def _defaults() -> None:
    from . import kernels

    register_metric(Metric("ged", lambda *c: kernels.graph_distance_udf()(*c), True, 0.0, "2", True, True))
    register_metric(Metric("type_match", lambda *c: kernels.type_match_udf()(*c), False, 1.0, "4"))
    register_metric(Metric("byte_match", lambda *c: kernels.line_diff_udf()(*c), False, 1.0, "5"))


_defaults()
