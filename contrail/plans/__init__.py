"""Named queries composed from the operators."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "validation_queries",
    "source_queries",
    "disruption_queries",
    "model_queries",
    "maintenance_queries",
    "monitoring_queries",
    "star_queries",
)


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"contrail.plans.{name}")
