"""CSV contract, partitioned sinks and streaming ingest."""
import os
import tempfile

from pyspark.sql import functions as F

from postsift.sources import csv_files
from postsift.streaming import ingest


def test_csv_round_trip_exact(spark):
    rows = [(1, 'q"uo,te', "u1"), (2, "a\nb", "u1"), (3, "c\r\nd", "u2"), (4, "NA", "u2"), (5, "null", "u2"), (6, " lead", "a+b"), (7, "trail  ", "50%"),
            (8, "\ttabs\t", "x/y"), (9, "  \nnl ", "a b"), (10, 'q"x ', "k=v"), (11, None, "u1"), (12, "", "u1"), (13, "no key", None)]
    df = spark.createDataFrame(rows, "id long, text string, screen_name string")
    path = tempfile.mkdtemp(prefix="csv-", dir="/tmp") + "/out"
    csv_files.write_csv(df, path, partition_by="screen_name")
    back = csv_files.read_csv(spark, path, spark.createDataFrame([], "id long, text string, screen_name string").schema, line_sep=None)
    assert sorted((r.id, r.text, r.screen_name) for r in back.collect()) == sorted(rows)


def test_key_of_a_foreign_file(spark):
    top = tempfile.mkdtemp(prefix="keys-", dir="/tmp")
    names = ["alice", "a b", "50%", "a+b", "k=v", "日本"]
    for n in names:
        with open(os.path.join(top, n + ".csv"), "w") as f:
            f.write("id\r\n1\r\n")
    df = csv_files.read_csv(spark, top, spark.createDataFrame([], "id long").schema)
    assert sorted(r.k for r in df.select(csv_files.key_from_file("src_file").alias("k")).collect()) == sorted(names)
    os.mkdir(os.path.join(top, "run=5"))
    with open(os.path.join(top, "run=5", "bob.csv"), "w") as f:
        f.write("id\r\n1\r\n")
    one = csv_files.read_csv(spark, os.path.join(top, "run=5"), spark.createDataFrame([], "id long").schema)
    assert [r.k for r in one.select(csv_files.key_from_file("src_file").alias("k")).collect()] == ["bob"]


def test_python_written_csv_with_japanese_header(spark):
    import csv
    d = tempfile.mkdtemp(prefix="csvpy-", dir="/tmp")
    with open(os.path.join(d, "alice.csv"), "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["Tweet_id", "ツイート内容"])
        w.writerow(["1", "line\r\nbreak"])
        w.writerow(["2", "lf\nonly"])
        w.writerow(["3", "NA"])
    schema = spark.createDataFrame([], "`Tweet_id` long, `ツイート内容` string").schema
    df = csv_files.canonical_names(csv_files.read_csv(spark, d, schema))
    got = sorted((r.tweet_id, r.text, r.k) for r in df.select("tweet_id", "text", csv_files.key_from_file("src_file").alias("k")).collect())
    assert got == [(1, "line\r\nbreak", "alice"), (2, "lf\nonly", "alice"), (3, "NA", "alice")]


def test_stream_ingest_of_overlapping_pages(spark):
    from postsift.plans import queries as Q
    sf = "/root/testdata/sf0.001"
    land = Q.landed_pages(spark, sf)
    from postsift.sources import json_posts
    landed = json_posts.flatten_posts(json_posts.read_pages(spark, land, "search"))
    ids = landed.select("tweet_id")
    assert ids.count() > ids.distinct().count() and landed.filter("is_retweet").count() > 0      # the input bites
    assert {"src_file", "page_pos", "created_at_raw"} <= set(landed.columns)
    out = ingest.ingest_pages(spark, land, files_per_trigger=1)
    want = {r.tweet_id for r in landed.filter("not is_retweet").collect()}
    got = [r.tweet_id for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert spark.conf.get(ingest.STATE_STORE, None) != ingest.ROCKSDB          # the session's own setting is back


def test_page_shapes_from_files(spark):
    from postsift.sources import json_posts
    d = tempfile.mkdtemp(prefix="pages-", dir="/tmp")
    with open(os.path.join(d, "timeline.json"), "w") as f:   # one pretty-printed page per file
        f.write('[\n  {"id": 5, "text": "a", "user": {"id_str": "9", "screen_name": "s"}},\n'
                '  {"id": 4, "text": "b", "in_reply_to_status_id": 3, "user": {"id_str": "9"}}\n]\n')
    tl = json_posts.flatten_posts(json_posts.read_pages(spark, d + "/timeline.json", "timeline", whole_files=True))
    assert sorted((r.tweet_id, r.user_id, r.is_reply) for r in tl.collect()) == [(4, 9, True), (5, 9, False)]
    with open(os.path.join(d, "rt.jsonl"), "w") as f:       # one page per line
        f.write('[{"user": {"id_str": "1", "name": "n1", "screen_name": "s1"}}, {"user": {"id_str": "2", "name": "n2", "screen_name": "s2"}}]\n')
        f.write('[]\n')
    rt = json_posts.flatten_retweeters(json_posts.read_pages(spark, d + "/rt.jsonl", "retweeters"))
    assert sorted((r.user_id, r.screen_name) for r in rt.collect()) == [(1, "s1"), (2, "s2")]
    with open(os.path.join(d, "list.jsonl"), "w") as f:
        f.write('{"users": [{"id": 7, "screen_name": "x", "name": "X"}]}\n')
    lm = json_posts.flatten_users(json_posts.read_pages(spark, d + "/list.jsonl", "list"))
    assert [(r.user_id, r.screen_name, r.user_name) for r in lm.collect()] == [(7, "x", "X")]


def test_segment_sink_overwrite_and_append(spark):
    from postsift.sinks import writers
    df = spark.createDataFrame([("a", "beauty_account"), ("b", "ordinaly_account")], "u string, segment string")
    path = tempfile.mkdtemp(prefix="seg-", dir="/tmp") + "/out"
    writers.write_segments(df, path)
    writers.write_segments(df, path)                  # rerun: idempotent
    assert spark.read.parquet(path).count() == 2
    for name in ("beauty_infulencer", "beauty_account", "lifestyle_account", "ordinaly_account"):
        one = spark.read.parquet(f"{path}/segment={name}")        # an empty segment has its schema
        assert one.columns == ["u"] and one.count() == (1 if name in ("beauty_account", "ordinaly_account") else 0)
    writers.write_segments(df, path, mode="append")   # the reference's appending behaviour
    assert spark.read.parquet(path).count() == 4


def test_high_water_mark_is_the_batch_cursor(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "tweet_id long")
    assert ingest.high_water_mark(df, "tweet_id", 4).count() == 5
    assert ingest.high_water_mark(df, "tweet_id", None).count() == 10


def test_watermark_dedup_keeps_everything_when_landed_in_time_order(spark):
    """The bounded-state mode (exact=False) is exact when landings arrive in event-time
    order; a repeated id inside the watermark delay is still dropped."""
    ev = (spark.read.parquet("/root/testdata/sf0.001/events.parquet")
          .select("event_id", "user_id", F.col("ts").cast("timestamp").alias("event_time")))
    land = tempfile.mkdtemp(prefix="land-", dir="/tmp")
    bounds = ev.selectExpr("percentile_approx(event_id, array(0.33, 0.66)) AS b").first()["b"]
    cuts = [-1, bounds[0], bounds[1], 10**12]
    for i in range(3):                           # three landings, oldest first
        part = ev.filter((F.col("event_id") > cuts[i]) & (F.col("event_id") <= cuts[i + 1]))
        if i == 2:
            part = part.unionByName(part.limit(5))   # repeated ids inside the last landing
        part.coalesce(1).write.parquet(f"{land}/l{i}")
    schema = ev.schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(land))
    out, ck = tempfile.mkdtemp(prefix="out-", dir="/tmp"), tempfile.mkdtemp(prefix="ck-", dir="/tmp")
    ingest.run_available(ingest.dedup_stream(stream, "event_id", "event_time", "1 day", exact=False), out, ck)
    got = spark.read.schema(schema).parquet(out)
    assert got.count() == ev.count()
    assert got.select("event_id").distinct().count() == ev.count()


def test_cluster_for_write_is_a_rebalance(spark):
    """Task sizes are AQE's (it merges small and splits large ones), not a fixed number."""
    df = spark.range(100).select((F.col("id") % 3).alias("key"), "id")
    plan = csv_files.cluster_for_write(df, "key")._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
