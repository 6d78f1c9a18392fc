"""Every query of the library's own operators, with its SQL."""

from lumenweir.plans import curation_queries, format_queries, manifest_queries, metric_queries, report_queries, schema_queries, session_queries, text_queries

MODULES = (text_queries, curation_queries, report_queries, metric_queries, format_queries, session_queries, schema_queries, manifest_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.SQL.items()}
