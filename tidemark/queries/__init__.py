"""Registered queries over the sample tables, each with its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

from tidemark.queries.registry import REGISTRY, Query

for _module in ("reads", "requests", "breakdowns", "snapshots", "scalars", "loads", "kpis", "reports"):
    import_module(f"tidemark.queries.{_module}")

__all__ = ["REGISTRY", "Query"]
