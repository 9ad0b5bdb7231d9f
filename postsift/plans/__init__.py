"""Registered queries, their DuckDB twins, table helpers and the Spark-vs-DuckDB compare."""
