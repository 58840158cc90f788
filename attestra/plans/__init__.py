"""Queries over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ["judging", "ruling", "texts", "permits", "matching", "scalars", "reporting", "intake"]


def load() -> dict:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    from .registry import QUERIES
    return QUERIES
