"""All registered queries of the metric engine and their SQL."""

from gaugeworks.plans import ingest_queries, metric_queries, sql_queries

QUERIES: dict = {**metric_queries.QUERIES, **ingest_queries.QUERIES, **sql_queries.QUERIES}
ORACLE_SQL: dict = {**metric_queries.SQL, **ingest_queries.SQL, **sql_queries.SQL}
