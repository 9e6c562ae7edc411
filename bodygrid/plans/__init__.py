"""Registered queries."""

import importlib
import pkgutil


def load():
    """Import every query module of this package and return the registry."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return importlib.import_module(f"{__name__}.registry")
