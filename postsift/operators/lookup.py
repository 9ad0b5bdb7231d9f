"""Tokens of a row looked up in a table, where the row is.

The head of the table (the rows that most tokens meet, at most ``HEAD_BYTES``) is sent to the
tasks as Arrow columns and met there, batch by batch: a row's tokens are neither exploded nor
shuffled.  If the table is all head, that is all.  Otherwise the tokens that the head does not
have are few: they alone are joined to the rest of the table, by a number given to the row when the
met rows were written.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD_BYTES = 24 << 20       # of the tokens and values sent to the tasks
PART_BYTES = 8 << 20        # of them looked up at once
TOKENS_TOGETHER = 1 << 20   # of a batch, looked up at once (or one row's)


def size(table: DataFrame, key: str, values: Sequence[str] = ()) -> int:
    """Bytes of the table's tokens and values."""
    n, text = table.agg(F.count(F.lit(1)), F.sum(F.octet_length(key))).first()
    return (text or 0) + n * (8 + 8 * len(values))


def head(table: DataFrame, key: str, values: Sequence[str], weight: Column, most: int | None = None) -> tuple[list, DataFrame | None]:
    """The rows of ``table`` (distinct, non-null ``key``) with the largest ``weight`` as Arrow parts, and the
    other rows (None: there are none).  At most about ``most`` bytes go through the driver."""
    most = most or HEAD_BYTES
    rows = table.select(F.col(key), *values, weight.cast("double").alias("_weight"))
    total, rest = size(table, key, values), None
    if total > most:
        # strictly above a quantile: ties at the bound stay outside, however many
        bound = rows.agg(F.percentile_approx("_weight", 1.0 - 0.9 * most / total, 100_000)).first()[0]
        above = F.coalesce(F.col("_weight") > F.lit(bound), F.lit(False))
        rest, rows = table.filter(~F.coalesce(weight.cast("double") > F.lit(bound), F.lit(False))), rows.filter(above)
    found = rows.select(key, *values).toArrow().combine_chunks()
    step = max(1, int(found.num_rows * PART_BYTES / max(1, found.nbytes)))
    return [found.slice(i, step).combine_chunks().to_batches()[0] for i in range(0, found.num_rows, step)], rest


def places(tokens: pa.Array, parts: list):
    """For each part its own places of ``tokens``: an int32 array with nulls."""
    for part in parts:
        yield part, pc.index_in(tokens, value_set=part.column(0).cast(tokens.type))


def slices(batch: pa.RecordBatch, at: int):
    """``batch`` in slices whose lists in column ``at`` have about ``TOKENS_TOGETHER`` elements, one row at least."""
    first = size = 0
    for i, n in enumerate(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_pylist()):
        if i > first and size + n > TOKENS_TOGETHER:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < batch.num_rows:
        yield batch.slice(first)


def offsets(lists: pa.Array):
    """Where each list begins in ``pc.list_flatten(lists)``, and where the last one ends; null lists are empty."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def lists_of(values: pa.Array, chosen, bounds) -> pa.Array:
    """The ``chosen`` (bool) of ``values`` as lists by the old ``bounds``."""
    upto = np.concatenate([[0], np.cumsum(chosen)])
    return pa.ListArray.from_arrays(pa.array(upto[bounds], pa.int32()), values.filter(pa.array(chosen)))


__all__ = ["size", "head", "places", "slices", "offsets", "lists_of"]
