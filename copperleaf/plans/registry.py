"""All core queries and their SQL, by name."""

from __future__ import annotations

import inspect

from copperleaf.plans import oracles, queries

QUERIES = {
    name: f for name, f in inspect.getmembers(queries, inspect.isfunction) if f.__module__ == queries.__name__ and not name.startswith("_")
}
ORACLES = oracles.ORACLES
