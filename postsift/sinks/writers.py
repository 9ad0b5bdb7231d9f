"""Sinks (S9-S15).  Every writer is one distributed write; reruns overwrite (idempotent)
unless ``mode='append'`` is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import label_line
from ..operators.segment import SEGMENTS
from ..sources.csv_files import cluster_for_write, write_csv

__all__ = ["write_csv", "write_segments", "write_training_text", "training_lines", "cluster_for_write"]


def write_segments(segmented: DataFrame, path: str, mode: str = "overwrite", segments=SEGMENTS) -> None:
    """S10 + S13 + S14 + S15: one table partitioned by ``segment`` (replaces the reference's
    four appended files); ``mode='append'`` reproduces appending.  Each of ``segments`` has
    a directory with the schema, also when it has no rows."""
    spark = segmented.sparkSession
    (cluster_for_write(segmented, "segment").write.mode(mode).option("partitionOverwriteMode", "static")
     .partitionBy("segment").parquet(path))
    there = {r["segment"] for r in spark.read.schema(segmented.schema).parquet(path).select("segment").distinct().collect()}
    rest = T.StructType([f for f in segmented.schema.fields if f.name != "segment"])
    for name in segments:
        if name not in there:
            spark.createDataFrame([], rest).coalesce(1).write.mode("append").parquet(f"{path}/segment={name}")


def training_lines(df: DataFrame, label_col: str, words_col: str) -> DataFrame:
    """One line ``__label__X, w1 w2 …`` per post."""
    return df.select(label_col, label_line(F.col(label_col), F.col(words_col)).alias("line"))


def write_training_text(lines: DataFrame, path: str, label_col: str = "label", mode: str = "overwrite") -> None:
    """S11 + S12: text files per label (``label=<x>/part-…``); reading the directory back
    is the merged corpus.  Nothing is written for an empty input."""
    (lines.select(label_col, "line").write.mode(mode).partitionBy(label_col).text(path))
