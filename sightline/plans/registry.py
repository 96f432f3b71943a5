"""All core queries by name, with the SQL they must agree with."""

from __future__ import annotations

from sightline.plans import files, hits, search, stats, store, triage

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (search, files, hits, triage, stats, store):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
