"""Registered queries by area."""

from __future__ import annotations

import importlib

MODULES = ("catalogue", "sky", "jobs", "matching", "image", "stacking", "quality", "streams")


def load_all():
    """Import every plan module once and return the registry."""
    from lumenfield.plans.registry import QUERIES

    for m in MODULES:
        importlib.import_module(f"lumenfield.plans.{m}")
    return QUERIES
