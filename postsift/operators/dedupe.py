"""Ordered de-duplication and per-key caps.

Arrival order is data: every operator takes explicit order columns (`seq`), never file
order.  Keep-first/keep-last is a grouped ``min_by``/``max_by`` over a struct of the row,
which Spark plans as partial + final aggregation: each map task reduces its rows to one
per key before the shuffle, so a key holding a third of all rows costs one row per map
task on the wire instead of a third of the table in one reducer.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``.  NULL keys form one group, as
    in the reference.  ``order`` must be a total order within a key."""
    cols = df.columns
    rec = F.struct(*[F.col(c) for c in cols])
    okey = F.struct(*_cols(order))
    pick = F.max_by(rec, okey) if last else F.min_by(rec, okey)
    return df.groupBy(*keys).agg(pick.alias("_kept")).select(*[F.col(f"_kept.{c}").alias(c) for c in cols])


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Keep the first row per key."""
    return keep_one(df, keys, order, last=False)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Keep the last row per key."""
    return keep_one(df, keys, order, last=True)


def dedupe_then_filter(df: DataFrame, keys: Sequence[str], order: Sequence, predicate: Column) -> DataFrame:
    """De-duplicate first, then filter.  The filter must stay above the de-dup (a key
    whose first row fails the predicate disappears); a DataFrame built in this order keeps
    it there — Catalyst does not push a filter through an aggregate on non-key columns."""
    return dedupe_first(df, keys, order).filter(predicate)


def row_number_in(keys: Sequence[str], order: Sequence) -> Column:
    """Position within a key by the given order (1-based)."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(order)))


SALTS = 32                     # parts in which a key is capped before it is capped as a whole
LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, total: int) -> DataFrame:
    """At most ``total`` rows per key in ``order``; ``total <= 0`` = unlimited.

    Two levels, whatever the input: rows are salted by a hash of their order columns and
    capped per (key, salt), then the at most ``SALTS * total`` survivors of a key are capped
    again.  Exact: the top rows of a key are among the top rows of its parts.  Both levels
    are ``row_number() <= total``, which Spark plans with a limit below the shuffle, so a map
    task forwards at most ``total`` rows per key and salt.  Spark does so up to the session's
    ``windowGroupLimitThreshold`` (default 1000); a larger ``total`` raises that setting.

    Only the columns of ``df`` travel: cap narrow rows and join wide columns back.
    ``order`` must be a total order within a key."""
    if total is None or total <= 0:
        return df
    conf = df.sparkSession.conf
    if int(conf.get(LIMIT_CONF, "1000")) < total:
        conf.set(LIMIT_CONF, str(total))
    order = _cols(order)
    plain = [c for c in df.columns if c not in keys]
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*(plain or keys)), F.lit(SALTS)))
    df = df.withColumn("_rn", row_number_in([*keys, "_salt"], order)).filter(F.col("_rn") <= total).drop("_rn", "_salt")
    return df.withColumn("_rn", row_number_in(keys, order)).filter(F.col("_rn") <= total).drop("_rn")


def newest_first(id_col: str = "tweet_id") -> list[Column]:
    """L4: the descending-id cursor order of the paged source."""
    return [F.col(id_col).desc()]


def rotate_positions(pos: Column, n: Column) -> Column:
    """The scraped list was written with index ``i-1`` for ``i in range(n)``, so
    element ``pos`` (0-based) lands at output row ``(pos + 1) % n``."""
    return F.pmod(pos + F.lit(1), n)
