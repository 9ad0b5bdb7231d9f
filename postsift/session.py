"""Session helpers: a tuned local session for tests/bench and a shared scratch area.

Nothing here is needed on a cluster where the operator already owns the session; the
library functions only take and return DataFrames.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter for every job in this library.  AQE re-plans joins from
# runtime sizes (a side is broadcast only when its measured size is under the
# threshold) and splits skewed shuffle partitions of sort-merge joins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the map-side limit of `row_number() <= k` also for the caps of several thousand rows
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "postsift",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written intermediate tables: the context's
    checkpoint dir, or ``spark.checkpoint.dir``.  On a ``local`` master without either (tests)
    a private temporary folder stands in; on any other master that would be one folder per
    machine, so it is an error."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_roots.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="postsift-ckpt-"))


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table under the checkpoint root that no later plan reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/postsift-{name}-{uuid.uuid4().hex[:12]}"


# Spark's own removal of a query's shuffle files when the query has ended.
SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Jobs that are run inside leave no shuffle files; the session's setting comes back.  For chains of
    written tables, whose shuffles nothing reads again."""
    before = spark.conf.get(SHUFFLES_REMOVED, None)
    try:
        spark.conf.set(SHUFFLES_REMOVED, "true")
        yield
    finally:
        spark.conf.unset(SHUFFLES_REMOVED) if before is None else spark.conf.set(SHUFFLES_REMOVED, before)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files that no plan can read any more go now, also where the setting above does not remove
    them: Spark's cleaner takes them when the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


__all__ = ["get_spark", "checkpoint_root", "scratch_path", "remove_scratch", "shuffles_removed", "free_shuffles", "DEFAULT_CONF"]
