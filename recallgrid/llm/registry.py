"""The queries of this subpackage by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from recallgrid.llm import clusters, conversations, leakage, neighbours, personal, representative, splitting, tokenizing, truncation

MODULES = (personal, clusters, neighbours, conversations, leakage, representative, splitting, tokenizing, truncation)
QUERIES: dict = {}
ORACLE: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
