"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("lobbying", "investigations", "reporting")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"daybook.plans.{name}")
