"""The library's queries by name, and their SQL."""

from skeinworks.plans import access_queries, build_queries, graph_queries, record_queries, stream_queries, text_queries

MODULES = (graph_queries, build_queries, text_queries, record_queries, stream_queries, access_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
