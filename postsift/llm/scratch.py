"""Written intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

``Scratch.keep`` writes a DataFrame once as Parquet and reads it back: lineage is cut, a
lost executor re-reads files, and the planner sees real sizes.  ``drop`` removes a table
that no later plan reads any more.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{what}")
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t))
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop_others(self, *stay: DataFrame) -> None:
        """Remove all tables but these."""
        ids = {id(t) for t in stay}
        self.drop(*[t for k, (t, _) in list(self.paths.items()) if k not in ids])


# Spark's own Bloom filter on the large side of a shuffled join, also for scans that are
# smaller than its default asks for.  The filter's size is bounded by Spark.
RUNTIME_FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
}


@contextmanager
def runtime_filters(spark: SparkSession):
    """Plans that are run inside use runtime filters; the session's settings come back."""
    before = {k: spark.conf.get(k, None) for k in RUNTIME_FILTER}
    try:
        for k, v in RUNTIME_FILTER.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
