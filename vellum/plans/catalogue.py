"""All queries of the operator inventory, bound to the test tables."""

from __future__ import annotations

from vellum.plans import batches, blocks, contracts, documents, evidence, layout, nesting, ordered, papers, points, relational, reports, streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in (blocks, relational, ordered, layout, evidence, points, batches, streams, nesting, contracts, papers, reports, documents):
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
