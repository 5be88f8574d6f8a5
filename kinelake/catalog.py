"""Every query of the engine by name, and its DuckDB equivalent."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from kinelake import plans


def _modules() -> list:
    return [importlib.import_module(f"kinelake.plans.{m.name}") for m in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name)]


def queries() -> dict[str, Callable]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLES.items()}
