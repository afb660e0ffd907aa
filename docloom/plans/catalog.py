"""Every registered query of the core, with the SQL that must give the same rows."""

from __future__ import annotations

from docloom.plans import builds, corpus, package, retrieval, telemetry

FLAGSHIP = "hybrid_topk"

QUERIES = builds.QUERIES | corpus.QUERIES | package.QUERIES | retrieval.QUERIES | telemetry.QUERIES
SQL = builds.SQL | corpus.SQL | package.SQL | retrieval.SQL | telemetry.SQL
