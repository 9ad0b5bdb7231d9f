"""Mixing sources to target weights (operator 4).

Words of a source, its documents in a hashed order, form a stream that is cut into blocks
of ``block_words`` (the last one may be shorter).  The mix is a sequence of output shards
of ``shard_blocks`` slots.  For each shard the number of slots of every source is drawn
multinomially; slot j of a source is block perm(j mod blocks), perm being a pseudorandom
permutation of the source's block numbers that is new in each pass over them.  Blocks are
joined to slots by (source, block number).

Draws go down a binary tree over the output shards: a node splits what is left of each
source's slots between its halves by a multinomial draw that is seeded by the node alone
and kept within what is left.  So every shard finds its counts, and where its slots start
in each source, on its own; the sums over all shards are the quotas, target words divided
by the words of a mean block.  A quota is at most ``most`` passes over the source.

Only the table of sources (name and size) goes through the driver; it is refused above
``MAX_SOURCES`` rows.
"""

from __future__ import annotations

import re
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .memory import handing_back

MAX_SOURCES = 100_000
BUCKETS = 256            # parts of a source's stream that are summed on their own
BLOCK_WORDS = 64
SHARD_BLOCKS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of the sum of ``sizes`` by weight; what exceeds ``most`` times a source's
    size is shared again among the others by weight, until nothing does."""
    out, rest, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] > most * sizes[i] * total]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _rng(*key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(key)))


def split_draw(quota: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """A multinomial draw of ``slots`` in proportion to ``quota``, kept within it."""
    left = int(quota.sum())
    got = np.minimum(rng.multinomial(slots, quota / left), quota) if left else np.zeros_like(quota)
    while (short := slots - int(got.sum())) > 0:
        room = quota - got
        got = got + np.minimum(rng.multinomial(short, room / room.sum()), room)
    return got


def shard_counts(quota: np.ndarray, shard_blocks: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one output shard, and the number of the first of them."""
    total = int(quota.sum())
    low, high, first = 0, -(-total // shard_blocks), np.zeros_like(quota)
    while high - low > 1:
        mid = (low + high) // 2
        left = split_draw(quota, (mid - low) * shard_blocks, _rng(seed, low, high))
        if shard < mid:
            quota, high = left, mid
        else:
            quota, low, first = quota - left, mid, first + left
    return quota, first


def permuted(j: np.ndarray, n: int, *key: int) -> np.ndarray:
    """Images of ``j`` under a pseudorandom permutation of range(n): a Feistel network on
    the next even number of bits, walked until the image is below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = [int(x) | 1 for x in np.random.SeedSequence(key).generate_state(6, np.uint64)]
    out = np.asarray(j, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        a, b = x >> np.uint64(half), x & mask
        for r in rounds:
            f = (b + np.uint64(r >> 32)) * np.uint64(r)
            f ^= f >> np.uint64(29)
            f = f * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sources(rows: DataFrame, weights: Sequence[float], most: float, block_words: int) -> pd.DataFrame:
    """One row per source by code point, null last: source, size, target, blocks, quota.
    ``weights`` repeat over the sources."""
    got = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    got.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be", "surrogatepass")))
    size = np.array([r["size"] for r in got], np.int64)
    target = targets(size.tolist(), [weights[i % len(weights)] for i in range(len(got))], most)
    blocks = -(-size // block_words)
    quota = np.rint(np.array(target) * blocks / np.maximum(size, 1)).astype(np.int64)
    return pd.DataFrame({"source": pd.Series([r.source for r in got], dtype=object), "size": size, "target": np.array(target, float),
                         "blocks": blocks, "quota": np.minimum(quota, (most * blocks).astype(np.int64))})


def slots(spark, table: pd.DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """The mix: out_shard, position, src (number of the source), block."""
    quota, blocks = table["quota"].to_numpy(), table["blocks"].to_numpy()
    shards = -(-int(quota.sum()) // shard_blocks)

    @handing_back

    def run(batches):
        for b in batches:
            for k in b["id"]:
                counts, first = shard_counts(quota, shard_blocks, int(k), seed)
                src, block = [], []
                for s in np.flatnonzero(counts):
                    j = np.arange(first[s], first[s] + counts[s])
                    turn = j // blocks[s]
                    for t in np.unique(turn):
                        block.append(permuted(j[turn == t] % blocks[s], int(blocks[s]), seed, int(s), int(t)))
                        src.append(np.full(len(block[-1]), s))
                order = _rng(seed, 1 << 40, int(k)).permutation(int(counts.sum()))
                yield pd.DataFrame({"out_shard": int(k), "position": np.arange(len(order)),
                                    "src": np.concatenate(src)[order], "block": np.concatenate(block)[order]})

    parts = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, shards, 1, parts).mapInPandas(run, "out_shard long, position long, src long, block long")


def placed(docs: DataFrame, numbers: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Rows of ``docs`` (id, source, size, carry) with src and start, the first word's
    number in the source's stream.  Documents without words get a start too, which the
    next document shares."""
    tie = [F.xxhash64(*carry)] if carry else []
    d = docs.join(numbers, docs["source"].eqNullSafe(numbers["name"]))
    d = d.withColumn("order", F.xxhash64("id", "size", "src")).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (d.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
              .select("src", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first")))
    inside = Window.partitionBy("src", "bucket").orderBy("order", "id", "size", *tie).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(firsts, ["src", "bucket"])
    return d.withColumn("start", (F.col("first") + F.col("inside")).cast("long")).drop("name", "order", "bucket", "first", "inside")


def pieces(starts: DataFrame, block_words: int) -> DataFrame:
    """One row per document and block that holds words of it: src, start, block, from_word
    and to_word (of the document)."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    rows = starts.filter("size > 0").select(
        "src", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)).alias("block"))
    return rows.select("src", "start", "block",
                       F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0)).alias("from_word"),
                       F.least((F.col("block") + 1) * block_words - F.col("start"), "size").alias("to_word"))


_spans = re.compile(WORD).finditer


def copies(text: str, words: int, drawn: list[tuple[int, int, int]]) -> list[str]:
    """The texts that a mix takes of one document of ``words`` words.  ``drawn``:
    (from_word, to_word, times) of its pieces, in any order.  Copy c holds the pieces that are taken at least c times;
    a stretch of words is cut out of the text as it stands, stretches are joined by line
    ends, and a copy of all words is the text itself."""
    drawn = sorted(drawn)
    out, spans = [], None
    for c in range(1, max((t for *_, t in drawn), default=0) + 1):
        runs = []
        for a, b, t in drawn:
            if t >= c:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        if runs == [[0, words]]:
            out.append(text)
            continue
        if spans is None:
            spans = [m.span() for m in _spans(text)]
        out.append("\n".join(text[spans[a][0]:spans[b - 1][1]] for a, b in runs))
    return out


def word_count(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


class Mix:
    """A mix of ``docs``; ``table`` has the sources, ``slots`` the sequence of blocks."""

    def __init__(self, docs: DataFrame, weights: Sequence[float], most: float = 3.0, block_words: int = BLOCK_WORDS,
                 shard_blocks: int = SHARD_BLOCKS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        spark = docs.sparkSession
        self.docs, self.block_words, self.id_col, self.text_col = docs, block_words, id_col, text_col
        self.source_col, self.scratch = source_col, Scratch(spark, "mix")
        self.rows = self.scratch.keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                                  word_count(text_col).alias("size")), "sizes")
        self.table = sources(self.rows, weights, most, block_words)
        self.slots = slots(spark, self.table, shard_blocks, seed)
        numbered = [(r[0], i, int(r[1]), float(r[2])) for i, r in enumerate(self.table.itertuples(index=False))]
        self.numbers = spark.createDataFrame([(n if isinstance(n, str) else None, *x) for n, *x in numbered],
                                             "name string, src long, source_size long, target double")

    def takes(self) -> DataFrame:
        """How often the mix takes each block: src, block, times.  The planner knows nothing of
        the size of the slots, nor of what exploding documents into pieces multiplies, so joins
        of the two ask for a merge join: neither side has a bound that would allow a broadcast."""
        return self.slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))

    def taken(self) -> DataFrame:
        """id_col, size, source_size, target, taken: one row per row of ``docs``."""
        starts = self.scratch.keep(placed(self.rows, self.numbers), "starts")
        words = (pieces(starts, self.block_words).hint("merge").join(self.takes(), ["src", "block"])
                 .groupBy("src", "start").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("times")).alias("taken")))
        full = starts.filter("size > 0").join(words, ["src", "start"], "left")
        out = full.unionByName(starts.filter("size = 0").withColumn("taken", F.lit(None).cast("long")))
        return out.select(F.col("id").alias(self.id_col), "size", "source_size", "target",
                          F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def documents(self, length_col: str = "n_chars") -> DataFrame:
        """The mixed corpus with the columns of ``docs``: one row for each copy of a
        document (see ``copies``), its length in ``length_col`` if there is one.  Documents
        of which nothing is taken, and those without words, are left out."""
        cols = self.docs.columns
        row = F.struct(*[F.col(c) for c in cols])
        docs = self.docs.select(F.col(self.id_col).alias("id"), F.col(self.source_col).cast("string").alias("source"),
                                word_count(self.text_col).alias("size"), row.alias("row")).filter("size > 0")
        starts = placed(docs, self.numbers, carry=["row"])
        narrow = self.scratch.keep(placed(self.rows.filter("size > 0").withColumn("row", F.lit(0)), self.numbers), "starts")
        drawn = (pieces(narrow, self.block_words).hint("merge").join(self.takes(), ["src", "block"])
                 .groupBy("src", "start").agg(F.collect_list(F.struct("from_word", "to_word", "times")).alias("drawn")))
        j = starts.select("src", "start", "size", "row").join(drawn, ["src", "start"])
        i = cols.index(self.text_col)

        @F.pandas_udf("array<string>")
        def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            @handing_back
            def run(batches):
                for texts, sizes, drawn in batches:
                    yield pd.Series([copies(t, n, [(x["from_word"], x["to_word"], x["times"]) for x in d])
                                     for t, n, d in zip(texts, sizes, drawn)], dtype=object)

            yield from run(batches)

        out = j.select("row", cut(F.col("row")[self.text_col], F.col("size"), F.col("drawn")).alias("copies"))
        out = out.select("row", F.explode("copies").alias("copy"))
        new = {cols[i]: F.col("copy")}
        if length_col in cols:
            new[length_col] = F.length("copy").cast(self.docs.schema[length_col].dataType)
        return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in cols])
