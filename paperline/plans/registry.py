"""Names of the registered queries, their DataFrame builders and their DuckDB SQL."""

from __future__ import annotations

from . import desk, documents, exports, money, resolving, scalars, sheets

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (scalars, money, resolving, documents, exports, desk, sheets):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
