"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from rostrum.plans import bouts, calendar, events, kinds, loads, people, readings, results, stewardship, texts

MODULES = (bouts, results, texts, calendar, stewardship, loads, people, kinds, events, readings)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    if twice := QUERIES.keys() & _module.R.queries.keys():
        raise ValueError(f"registered twice: {sorted(twice)}")
    QUERIES.update(_module.R.queries)
    ORACLES.update(_module.R.oracles)
