"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

One module per operator plus ``queries`` (the registered queries) and ``oracle`` (their
DuckDB SQL).  Nothing outside this subpackage imports it, except the guarded registration
in ``__spark_entry__``.  All sizes that bound a broadcast, a closure or a group are named
parameters in the modules.
"""
