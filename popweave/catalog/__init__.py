"""The registered queries: every operator acted out on the given tables."""

from popweave.catalog import (  # noqa: F401
    q_recodes,
    q_joins,
    q_tables,
    q_ranks,
    q_functions,
    q_merges,
    q_sources,
    q_spatial,
    q_jobs,
    q_populations,
    q_links,
)
from popweave.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
