"""Every query of the engine by name, with its SQL."""

from edgesmith.plans import graph_queries, sampling_queries, selector_queries

QUERIES: dict = {**graph_queries.QUERIES, **selector_queries.QUERIES, **sampling_queries.QUERIES}
SQL: dict = {**graph_queries.SQL, **selector_queries.SQL, **sampling_queries.SQL}
FLAGSHIP = "walk_candidates"
