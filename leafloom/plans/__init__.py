"""Derived input views and the registered queries with their SQL."""

from leafloom.plans import study_queries, table_queries, text_queries

QUERIES = {**text_queries.QUERIES, **table_queries.QUERIES, **study_queries.QUERIES}
SQL = {**text_queries.SQL, **table_queries.SQL, **study_queries.SQL}
