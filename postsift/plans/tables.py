"""Table access for the registered queries (parquet; Catalyst prunes columns and pushes
filters into the scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Session setting: number of tasks that CPU-heavy text queries deal their input to.  Unset
# (the default) there is no such shuffle, and a scan gives a task per split or row group.
# It is for inputs that are stored as a few row groups; it never depends on a size.
SPREAD_CONF = "spark.postsift.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_for_cpu(df: DataFrame) -> DataFrame:
    """``df`` dealt round-robin to as many tasks as ``spark.postsift.spread`` says, or
    unchanged when that is unset."""
    n = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(n)) if n else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the checkpoint folder and read it back: later
    passes read the table instead of recomputing the lineage (and survive executor
    loss); the planner sees the table's real size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
