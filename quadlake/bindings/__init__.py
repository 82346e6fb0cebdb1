"""Queries over the supplied tables, one module per operator family."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import every query module so that it registers its queries."""
    for info in iter_modules(__path__):
        if info.name.startswith("q_"):
            import_module(f"{__name__}.{info.name}")
