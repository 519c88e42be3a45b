"""All queries of the core by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from recallgrid.plans import complete, core_orphans, extended, further, graph_dream, relational, retrieval, streams, vectors_text

FLAGSHIP = "dr3_nrem"
QUERIES: dict = {**core_orphans.QUERIES}
ORACLE: dict = {**core_orphans.ORACLE}
for _m in (relational, vectors_text, retrieval, graph_dream, extended, further, complete, streams):
    QUERIES |= _m.R.queries
    ORACLE |= _m.R.oracle
