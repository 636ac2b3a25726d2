"""All queries of the core, with their SQL equivalents."""

from __future__ import annotations

from quorumlake.plans import constructs, oracle, pages_catalogue, pipeline, problems, views

FLAGSHIP = "q41_party_votes"


def queries() -> dict:
    return {**problems.QUERIES, **constructs.QUERIES, **pipeline.QUERIES, **pages_catalogue.QUERIES, **views.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**problems.ORACLE_SQL, **constructs.ORACLE_SQL, **pipeline.ORACLE_SQL, **oracle.ORACLE_SQL}
