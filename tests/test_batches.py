"""The sink by batch id: reruns, tries that broke off, empty batches, streams."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from postsift.operators.segment import SEGMENTS
from postsift.sinks import batches

A, B = SEGMENTS[0], SEGMENTS[3]


def rows(df):
    return sorted((r.batch, r.id, r.segment) for r in df.collect())


def test_reruns_and_tries_that_broke_off(spark):
    path = tempfile.mkdtemp(prefix="batches-", dir="/tmp") + "/t"
    df = spark.createDataFrame([(1, A), (2, A), (3, B)], "id long, segment string")
    assert rows(batches.read_batches(spark, path, df.schema)) == []
    for _ in range(2):
        assert batches.write_batch(df, path, 0) == {A: 2, SEGMENTS[1]: 0, SEGMENTS[2]: 0, B: 1, None: 0}
    batches.write_batch(df, path, 1)
    batches.write_batch(df.filter("id = 3").withColumn("id", F.lit(9).cast("long")), path, 1)      # other rows, fewer segments
    want = [(0, 1, A), (0, 2, A), (0, 3, B), (1, 9, B)]
    assert rows(batches.read_batches(spark, path, df.schema)) == want
    # a try that broke off: files, but no mark
    batches.write_batch(df, path, 2)
    os.remove(path + "/batch=2/_SUCCESS")
    assert rows(batches.read_batches(spark, path, df.schema)) == want
    batches.write_batch(df.filter("id = 1"), path, 2)
    assert rows(batches.read_batches(spark, path, df.schema)) == want + [(2, 1, A)]
    # an empty batch, null and unknown keys, a clashing column
    assert sum(batches.write_batch(df.limit(0), path, 3).values()) == 0
    assert len(batches.finished(spark, path)) == 4
    odd = spark.createDataFrame([(5, None), (6, "else")], "id long, segment string")
    assert batches.write_batch(odd, path, 4)[None] == 2
    got = [(r.id, r.segment) for r in batches.read_batches(spark, path, df.schema).filter("batch = 4").orderBy("id").collect()]
    assert got == [(5, None), (6, "else")]
    with pytest.raises(ValueError):
        batches.write_batch(df.withColumn("batch", F.lit(1)), path, 5)


def test_stream_batches_run_again(spark):
    d = tempfile.mkdtemp(prefix="batches-", dir="/tmp")
    df = spark.createDataFrame([(i, SEGMENTS[i % 4]) for i in range(20)], "id long, segment string")
    df.repartition(4).write.parquet(d + "/land")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(d + "/land")
    batches.write_stream_batches(stream, d + "/t", d + "/ck")
    first = rows(batches.read_batches(spark, d + "/t", df.schema))
    assert sorted(i for _, i, _ in first) == list(range(20)) and len({b for b, _, _ in first}) > 1
    # the last micro-batch was written, but the stream stopped before it was committed
    last = max(int(f) for f in os.listdir(d + "/ck/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{d}/ck/commits/{f}"):
            os.remove(f"{d}/ck/commits/{f}")
    batches.write_stream_batches(stream, d + "/t", d + "/ck")
    assert rows(batches.read_batches(spark, d + "/t", df.schema)) == first
