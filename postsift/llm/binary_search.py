"""Exact top-k search of binary codes by incremental multi-index hashing (operator 5).

A vector's code has one bit per component (1 where it is positive).  Codes are cut into
segments.  Two codes whose distance is at most m (r + 1) - 1 agree in one of the m segments
up to r bits; so once all codes that come within r bits of a query in some segment are
verified, every code up to that distance is known.  The radius r grows from 0, for the
queries whose k-th verified distance is not covered yet, until it is.

Equal codes are one entry that holds the k smallest ids, so a code that a third of the
vectors share costs no more than another.  A pair that several segments or radii find is
verified where it is found first, so that nothing has to be made distinct, and is kept only
if it is not farther than the k-th neighbour that its query has already.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SEGMENTS = 4


def width_of(vectors: DataFrame, vector_col: str = "embedding") -> int:
    """Components of the longest vector, made up to full words of 64 (64 at least): with that
    many bits a code has every component of every vector."""
    most = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    return max(1, -(-most // 64)) * 64


def code_of(vector: Column, bits: int) -> Column:
    """The code of a vector as 64-bit words, the first component being the highest bit of
    the first word.  Missing components, nulls and NaN give 0."""
    words = []
    for at in range(0, bits, 64):
        width = min(64, bits - at)
        on = F.slice(vector, at + 1, width)
        place = F.transform(on, lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(width - 1) - i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(place, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return F.array(*words)


def segments_of(code: Column, bits: int, segments: int) -> list[Column]:
    """The segments of a code, from its first bits on; a segment may not span two words."""
    width = bits // segments
    if width * segments != bits or 64 % width or width > 31:
        raise ValueError("segments must cut the code and its 64-bit words into equal parts of at most 31 bits")
    out = []
    for s in range(segments):
        word, at = divmod(s * width, 64)
        shift = min(64, bits - word * 64) - at - width
        out.append(F.shiftrightunsigned(code[word], shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int"))
    return out


def distance(a: Column, b: Column, bits: int) -> Column:
    parts = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(-(-bits // 64))]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out.cast("int")


def _smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """code and its k smallest ids (a bounded list; the window keeps k rows per task)."""
    by = Window.partitionBy("code").orderBy("id")
    first = rows.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= k)
    return first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int | None = None, segments: int | None = None,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (1 to k), neighbor_id, distance: for each row of ``queries`` the k
    rows of ``vectors`` with the least Hamming distance of their codes, by id on ties.
    ``bits`` is the length of the codes; vectors that are longer are refused, and without it
    the data give it.  ``segments`` is by default ``SEGMENTS`` for each 64 bits.

    Rows with a null id or null vector are left out on both sides.  A query that is in
    ``vectors`` finds itself.  Rows that repeat an id count each in ``vectors``; a query id
    that repeats gives its rows again.  With fewer than k vectors all of them are returned,
    with none the result is empty.  Other columns are ignored."""
    spark = vectors.sparkSession
    longest = max(width_of(vectors, vector_col), width_of(queries, vector_col))
    if bits is not None and longest > max(64, -(-bits // 64) * 64):
        raise ValueError(f"vectors are longer than {bits} components")
    bits = bits or longest
    segments = segments or SEGMENTS * max(1, bits // 64)
    scratch, width = Scratch(spark, "mih"), bits // segments

    def coded(df):
        df = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        return df.select("id", code_of(F.col("v"), bits).alias("code"))

    entries = scratch.keep(_smallest_ids(coded(vectors), k), "entries")
    asked = scratch.keep(coded(queries), "queries")
    parts = F.array(*[F.struct(F.lit(s).alias("seg"), c.alias("val")) for s, c in enumerate(segments_of(F.col("code"), bits, segments))])
    table = scratch.keep(entries.select("code", "ids", F.explode(parts).alias("p")).select("p.seg", "p.val", "code", "ids"), "table")

    # queries that go on, each with the k-th distance it has so far
    open_ = scratch.keep(asked.select("code").distinct().withColumn("kth", F.lit(bits)), "open")
    best, done = None, []
    by = Window.partitionBy("query").orderBy("distance", "id")
    for r in range(width + 1):
        masks = [sum(1 << i for i in c) for c in combinations(range(width), r)]
        probes = (open_.select(F.col("code").alias("query"), "kth", F.explode(parts).alias("p"))
                  .select("query", "kth", F.col("p.seg").alias("seg"), F.col("p.val").alias("own"), F.explode(F.array(*map(F.lit, masks))).alias("mask"))
                  .select("query", "kth", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("val")))
        # the planner's size of the probes does not see what the masks multiply, so it must
        # not choose them for a broadcast
        j = probes.hint("merge").join(table, ["seg", "val"])
        gaps = [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(segments_of(F.col("query"), bits, segments), segments_of(F.col("code"), bits, segments))]
        # found here first: smaller segments are farther than r, later ones not nearer
        first = F.lit(True)
        for s, g in enumerate(gaps):
            first = first & F.when(F.col("seg") > s, g > r).when(F.col("seg") < s, g >= r).otherwise(F.lit(True))
        far = distance(F.col("query"), F.col("code"), bits)
        found = j.filter(first & (far <= F.col("kth"))).select("query", far.alias("distance"), F.explode("ids").alias("id"))
        if best is not None:
            found = found.unionByName(best.join(open_.select(F.col("code").alias("query")), "query"))
        top = found.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= k).drop("nth")
        was, best = best, scratch.keep(top, "best")
        if was is not None:
            scratch.drop(was)
        covered = segments * (r + 1) - 1
        if r == width:
            done.append(best)
            break
        kth = best.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth"))
        state = open_.select(F.col("code").alias("query")).join(kth, "query", "left")
        settled = F.coalesce((F.col("n") >= k) & (F.col("kth") <= covered), F.lit(False))
        ended = scratch.keep(best.join(state.filter(settled).select("query"), "query", "left_semi"), "done")
        done.append(ended)
        least = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(bits)).alias("kth")
        rest = scratch.keep(state.filter(~settled).select(F.col("query").alias("code"), least), "open")
        scratch.drop(open_)
        open_ = rest
        if rest.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.withColumn("rank", F.row_number().over(by))
    return (asked.withColumnRenamed("id", "query_id").join(out, asked["code"] == out["query"])
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("neighbor_id"), "distance"))
