"""Named queries: each module registers its own; ``load_all`` gathers them."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> tuple[dict, dict]:
    """All registered queries and their SQL twins, by name."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    from skeinlog.plans.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
