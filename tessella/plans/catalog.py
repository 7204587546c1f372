"""Collects every plan module into one name → plan map."""

from __future__ import annotations

import importlib

from tessella.plans import registry

MODULES = ["text", "similarity", "habits", "notes", "messages", "inventory", "rules",
           "sentiment", "entities", "rooms",
           "sources"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessella.plans.{name}")


def queries() -> dict[str, registry.Plan]:
    _load()
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
