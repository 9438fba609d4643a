"""Queries over the given tables, one per operator."""

from importlib import import_module

_MODULES = ("q_ingest", "q_metrics", "q_redaction", "q_conversations", "q_capture", "q_streaming")


def load():
    """Import all query modules and return the registry they filled."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
