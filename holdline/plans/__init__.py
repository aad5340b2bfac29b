"""Registered queries over the driver's tables."""

from importlib import import_module

_MODULES = ("basics", "histories", "calibrations", "derived", "streams")


def all_queries() -> None:
    """Import the modules that register queries."""
    for name in _MODULES:
        import_module(f"holdline.plans.{name}")
