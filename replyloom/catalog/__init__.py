"""Queries over the given tables that exercise every operator."""

from importlib import import_module

_MODULES = ("message_queries", "evaluation_queries", "retrieval_queries")


def load_all() -> None:
    """Import the query modules, which register themselves."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
