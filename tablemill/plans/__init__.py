"""End-to-end jobs and the catalogue of checked queries."""

from __future__ import annotations

from importlib import import_module


def load_catalog():
    """The catalogue with every query module loaded."""
    for module in ("tables", "evaluation", "monitoring"):
        import_module(f"tablemill.plans.{module}")
    return import_module("tablemill.plans.catalog")
