"""postsift — post classification and audience segmentation as Spark DataFrame plans.

Subpackages: ``functions`` (column expressions: cleaning, tokens, parsing), ``operators``
(DataFrame -> DataFrame operators), ``sources`` / ``sinks`` (readers and writers),
``streaming`` (incremental ingest), ``plans`` (registered queries, DuckDB twins, table
helpers).  See README.md for the operator map and the scale design.
"""
