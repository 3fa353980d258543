"""Every named query."""

from __future__ import annotations

from tarmac.catalogue import factsheet, files, kpi, people, places, records, vehicles
from tarmac.catalogue.entry import Query

QUERIES: dict[str, Query] = {}
for part in (kpi, people, records, places, factsheet, vehicles, files):
    for name, query in part.catalogue.items.items():
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = query
