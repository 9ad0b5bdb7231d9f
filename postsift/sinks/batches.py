"""A sink by batch id (S10, S13-S15, A8): appending that can be repeated.

Every batch has a folder ``batch=<id>`` of its own under the table, partitioned further by the
segment.  Writing a batch replaces that folder and no other, so a batch written again, with the
same rows or others, leaves no rows of its earlier try; a try that broke off has no success
mark, and readers leave it out until it is written again.  How many rows went to each segment
is observed by the job that writes them; there is no second job.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.segment import SEGMENTS
from ..sources.csv_files import cluster_for_write

BATCH = "batch"


def write_batch(df: DataFrame, path: str, batch_id: int, key: str = "segment", keys: Sequence[str] = SEGMENTS) -> dict[str, int]:
    """Writes ``df`` as batch ``batch_id`` of the table at ``path``.  Returns the number of rows for
    each of ``keys`` (0 for those without rows) and for ``None``: rows with a null or any other
    key, which are written like all others.  An empty batch is a batch too."""
    if BATCH in df.columns:
        raise ValueError(f"the rows have a column {BATCH!r} already")
    seen = Observation()
    there = F.coalesce(F.col(key).isin(list(keys)), F.lit(False))
    counts = [F.count_if(F.col(key) == k).alias(f"n{i}") for i, k in enumerate(keys)]
    # observed behind the shuffle, in the tasks that write: a lost executor's rows count once
    rows = cluster_for_write(df, key).observe(seen, F.count_if(~there).alias("rest"), *counts)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(key).parquet(_folder(path, batch_id))
    got = seen.get
    return {**{k: int(got[f"n{i}"]) for i, k in enumerate(keys)}, None: int(got["rest"])}


def _folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/{BATCH}={int(batch_id)}"


def finished(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches that are whole (one name a batch)."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{BATCH}=*/_SUCCESS")
    there = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(str(s.getPath().getParent()) for s in there or [])


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all whole batches, with ``batch``.  ``schema`` is that of the rows written."""
    whole = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    folders = finished(spark, path)
    if not folders:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(*folders).select(*whole.names)


def write_stream_batches(stream: DataFrame, path: str, ckpt: str, key: str = "segment", keys: Sequence[str] = SEGMENTS) -> None:
    """Takes what a stream has now.  A micro-batch that is run again after a failure has the same id
    and replaces its first try."""
    q = (stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
         .foreachBatch(lambda rows, batch_id: write_batch(rows, path, batch_id, key, keys) and None).start())
    q.awaitTermination()
