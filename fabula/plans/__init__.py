"""Registered queries: importing a module of this package registers its queries."""

import importlib
import pkgutil

from . import registry


def _load() -> None:
    for m in pkgutil.iter_modules(__path__):
        if m.name != "registry":
            importlib.import_module(f"{__name__}.{m.name}")


def all_queries() -> dict:
    _load()
    return registry.QUERIES


def all_sql() -> dict:
    _load()
    return registry.SQL
