"""Ready-made queries over the standard tables, each with its SQL twin."""

from importlib import import_module

MODULES = ("retrieval", "ingest", "text", "evaluation", "service")


def load_all() -> None:
    """Import every plan module, which registers its queries."""
    for name in MODULES:
        import_module(f"quaestor.plans.{name}")
