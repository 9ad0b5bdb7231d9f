"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards (operator 12).

Terms are the maximal runs of digits, letters A-Z (lower-cased) and characters beyond ASCII;
that class is a class of UTF-8 bytes, so the work is done on bytes.  A term is known by a
64-bit hash.  With N documents that hold a term, L terms in them and n in the document at hand, its
norm is ``m = 50 + (50 n N) div L``, an occurrence count tf is worth
``part = (10^9 tf) div (1000 tf + 20 m)``, and a document scores the sum of ``w * part`` over
the query's terms, w from the documents df that hold the term.

1. Statistics: one pass counts N and L.
2. Index: every task cuts its documents into shards of about ``SHARD_BYTES`` of text and writes
   one row per shard and term: postings as variable-length gaps and counts, in blocks of
   ``BLOCK`` postings with their last document, largest part and end.  One more row per
   shard holds the documents' ids and norms.
3. Weights: df is a sum over the index rows of the queries' terms.
4. Search: the queries, in blocks of ``QUERY_BLOCK``, meet the index rows of their terms by an
   equi-join; a shard answers a block of queries with a heap of k documents for each.  Lists are
   taken from the largest bound (w times the list's largest part) down; once the bounds of the
   lists left sum to less than the k-th score so far, these are non-essential: no new
   document can get in, and those seen are asked list by list, with the block's largest part
   rejecting most of them before the block is decompressed.
5. The shards' heaps are merged by a window that keeps k rows per query and task before the
   shuffle.

A frequent term has one row per shard, a shard is of bounded size, and a group of step 4 holds a
shard's lists of one block of queries: no key grows with the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import U, mix
from .memory import handing_back
from .scratch import Scratch

SHARD_BYTES = 16 << 20      # UTF-8 bytes of the texts of one shard (more if one text is longer)
BLOCK = 64                  # postings in one block
QUERY_BLOCK = 256           # queries that one call on a shard answers
HASH_BYTES = 1 << 20        # bytes that are hashed at a time, cut between terms
IDS = 0                     # the "term" of the row with a shard's ids and norms

_BASE = U(0x9E3779B97F4A7C15)
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_VALUE = mix(np.arange(1, 257, dtype=U) * _BASE)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]


def _pieces(b: np.ndarray):
    """(start, end) of pieces of about ``HASH_BYTES`` that cut no term."""
    at = 0
    while at < len(b):
        end = min(len(b), at + HASH_BYTES)
        while end < len(b) and _TERM[b[end - 1]] and _TERM[b[end]]:
            gap = np.flatnonzero(~_TERM[b[end:end + HASH_BYTES]])
            end = end + int(gap[0]) if len(gap) else min(len(b), end + HASH_BYTES)
        yield at, end
        at = end


def terms(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every term in UTF-8 bytes, in order."""
    hashes, places = [np.empty(0, U)], [np.empty(0, np.int64)]
    for at, end in _pieces(b):
        piece = b[at:end]
        inside = _TERM[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        value = _VALUE[piece]
        value[~inside] = 0
        widths = np.diff(np.append(starts, len(piece)))
        offset = np.arange(starts[0], len(piece)) - np.repeat(starts, widths)
        powers = np.cumprod(np.full(int(widths.max()), _BASE, U))
        h = mix(np.add.reduceat(value[starts[0]:] * powers[offset], starts - starts[0]))
        hashes.append(np.where(h == U(IDS), U(1), h))
        places.append(starts + at)
    return np.concatenate(hashes), np.concatenate(places)


def _joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a space after each, and where each begins."""
    lengths = np.array([len(t) if t else 0 for t in texts], np.int64) + 1
    data = b"".join(part for t in texts for part in (t or b"", b" "))
    return np.frombuffer(data, np.uint8), np.cumsum(lengths) - lengths


def term_rows(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every term of some texts (bytes or null)."""
    data, starts = _joined(texts)
    hashes, places = terms(data)
    return hashes, np.searchsorted(starts, places, "right") - 1


# ------------------------------------------------------------------ postings
def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes (seven bits each, low ones first) of numbers, and each one's length."""
    values = values.astype(U)
    size = np.ones(len(values), np.int64)
    for shift in range(7, 64, 7):
        size += values >= U(1 << shift)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        more = size > k
        byte = (values[more] >> U(7 * k)) & U(127)
        out[at[more] + k] = (byte | np.where(size[more] > k + 1, U(128), U(0))).astype(np.uint8)
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def parts_of(tf: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * norms)


@dataclass(frozen=True)
class Corpus:
    """N and L of the scores."""
    documents: int
    terms: int

    def norms(self, counts) -> np.ndarray:
        """m of documents with these numbers of terms (exact at any size)."""
        return np.array([50 + 50 * int(n) * self.documents // self.terms for n in counts], np.int64)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of ``values`` up to each of ``ends`` (in values)."""
    offsets = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def shard_rows(ids: list, texts: list, corpus: Corpus, kind: pa.DataType, shard: int) -> pa.RecordBatch:
    """The index rows of a shard; documents are numbered by ascending id (nulls last)."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
    ids = [ids[i] for i in order]
    hashes, docs = term_rows([texts[i] for i in order])
    norms = corpus.norms(np.bincount(docs, minlength=len(ids)))
    by = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[by], docs[by]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(fresh)
    tf = np.diff(np.append(at, len(hashes)))
    hashes, docs = hashes[at], docs[at]
    part = parts_of(tf, norms[docs])
    head = np.ones(len(hashes), bool)
    head[1:] = hashes[1:] != hashes[:-1]
    lists = np.flatnonzero(head)
    df = np.diff(np.append(lists, len(hashes)))
    place = np.arange(len(hashes)) - np.repeat(lists, df)
    blocks = np.flatnonzero(place % BLOCK == 0)
    before = np.concatenate([[0], docs[:-1]])
    gap = np.where(head, docs + 1, docs - before)
    data, size = pack(np.stack([gap, tf], 1).reshape(-1))
    done = np.cumsum(size.reshape(-1, 2).sum(1)) if len(size) else np.empty(0, np.int64)
    stop = np.append(blocks[1:], len(hashes)) - 1 if len(blocks) else blocks
    list_end = done[lists + df - 1] if len(lists) else done
    list_start = np.concatenate([[0], list_end[:-1]])
    n_blocks = -(-df // BLOCK)
    peak = np.maximum.reduceat(part, blocks) if len(blocks) else part
    ends = done[stop] - np.repeat(list_start, n_blocks) if len(blocks) else done
    upto = np.cumsum(n_blocks)
    k = len(lists)
    none = pa.nulls(1, pa.binary())
    cols = {
        "shard": pa.array(np.full(k + 1, shard, np.int64)),
        "term": pa.array(np.append(hashes[lists].view(np.int64), IDS)),
        "df": pa.array(np.append(df, 0).astype(np.int64)),
        "top": pa.array(np.append(np.maximum.reduceat(part, lists) if k else part, 0).astype(np.int64)),
        "last": pa.concat_arrays([_cut(docs[stop].astype("<u4") if k else np.empty(0, "<u4"), upto), none]),
        "peak": pa.concat_arrays([_cut(peak.astype("<u4"), upto), none]),
        "ends": pa.concat_arrays([_cut(ends.astype("<u4"), upto), none]),
        "body": pa.concat_arrays([_cut(data, list_end), none]),
        "ids": pa.concat_arrays([pa.nulls(k, pa.list_(kind)), pa.array([ids], pa.list_(kind))]),
        "norms": pa.concat_arrays([pa.nulls(k, pa.list_(pa.int64())), pa.array([norms], pa.list_(pa.int64()))]),
    }
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


class Postings:
    """The list of a term in a shard; blocks are decompressed when asked for."""

    def __init__(self, last: bytes, peak: bytes, ends: bytes, body: bytes, norms: np.ndarray):
        self.last, self.peak, self.ends = (np.frombuffer(x, "<u4").astype(np.int64) for x in (last, peak, ends))
        self.body, self.norms, self.opened = np.frombuffer(body, np.uint8), norms, {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and parts of block i."""
        if i not in self.opened:
            v = unpack(self.body[self.ends[i - 1] if i else 0:self.ends[i]])
            docs = np.cumsum(v[::2]) + (self.last[i - 1] if i else -1)
            self.opened[i] = docs, parts_of(v[1::2], self.norms[docs])
        return self.opened[i]

    def blocks(self, which) -> tuple[np.ndarray, np.ndarray]:
        got = [self.block(int(i)) for i in which]
        return np.concatenate([d for d, _ in got]), np.concatenate([p for _, p in got])

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.last) == 1:
            return self.block(0)
        v = unpack(self.body)
        docs = np.cumsum(v[::2]) - 1
        return docs, parts_of(v[1::2], self.norms[docs])


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def top_documents(lists: list, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Block-Max MaxScore in one shard: numbers and scores of the k best documents with a score
    above 0 (equal scores: lower numbers first), for ``lists`` of (w, top, postings)."""
    lists = sorted((x for x in lists if x[0] > 0 and x[1] > 0), key=lambda x: -x[0] * x[1])
    bound = [w * top for w, top, _ in lists]
    rest = np.concatenate([np.cumsum(bound[::-1], dtype=np.int64)[::-1], [0]]) if lists else np.zeros(1, np.int64)
    score, least, i = np.zeros(n_docs, np.int64), 0, 0
    while i < len(lists) and rest[i] >= least:                  # essential lists: every posting counts
        w, _, postings = lists[i]
        docs, part = postings.whole()
        score[docs] += w * part
        i += 1
        least = _kth(score[score > 0], k)
    seen = np.flatnonzero((score > 0) & (score + rest[i] >= least))
    for j in range(i, len(lists)):                              # non-essential lists
        w, _, postings = lists[j]
        where = np.searchsorted(postings.last, seen)
        inside = where < len(postings.last)
        most = np.where(inside, w * postings.peak[np.minimum(where, len(postings.last) - 1)], 0)
        alive = score[seen] + most + rest[j + 1] >= least
        seen, asked = seen[alive], np.unique(where[alive & inside])
        if len(asked):
            docs, part = postings.blocks(asked)
            at = np.minimum(np.searchsorted(docs, seen), len(docs) - 1)
            hit = docs[at] == seen
            score[seen[hit]] += w * part[at[hit]]
            least = max(least, _kth(score[seen], k))
        seen = seen[score[seen] + rest[j + 1] >= least]
    best = seen[np.lexsort((seen, -score[seen]))][:k]
    return best, score[best]


# ------------------------------------------------------------------ jobs
def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def corpus_of(docs: DataFrame, text_col: str = "text") -> Corpus:
    """N and L, in one pass."""
    @handing_back
    def run(batches):
        for b in batches:
            _, owner = term_rows(b.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"n": [len(np.unique(owner))], "l": [len(owner)]})

    row = _texts(docs, text_col, text_col).mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return Corpus(int(row[0] or 0), int(row[1] or 0))


def index(docs: DataFrame, corpus: Corpus, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index rows of ``docs`` (see the module text); every document is in one shard."""
    field = docs.schema[id_col].dataType

    @handing_back
    def run(batches):
        shard, ids, texts, size, kind = TaskContext.get().partitionId() << 24, [], [], 0, None
        for b in batches:
            kind = b.column(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(key)
                texts.append(text)
                size += len(text or b"") + 1
                if size >= SHARD_BYTES:
                    yield shard_rows(ids, texts, corpus, kind, shard)
                    shard, ids, texts, size = shard + 1, [], [], 0
        if ids:
            yield shard_rows(ids, texts, corpus, kind, shard)

    return _texts(docs, id_col, text_col).mapInArrow(
        run, f"shard long, term long, df long, top long, last binary, peak binary, ends binary, body binary, ids array<{field.simpleString()}>, norms array<long>")


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item and term, once each, of every query."""
    kind = items.schema[item_col].dataType.simpleString()

    @handing_back
    def run(batches):
        for b in batches:
            hashes, owner = term_rows(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(hashes.view(np.int64))], ["item", "term"])

    return _texts(items, item_col, text_col).mapInArrow(run, f"item {kind}, term long").distinct()


def _answers(k: int, item_kind: pa.DataType, id_kind: pa.DataType):
    """Function of a shard's rows for a block of queries: the shard's heap of each query."""
    def run(rows: pa.Table) -> pa.Table:
        col = {c: rows.column(c).to_pylist() for c in ("term", "w", "top", "items", "last", "peak", "ends", "body")}
        own = col["term"].index(IDS)
        ids = rows.column("ids")[own].as_py()
        norms = np.array(rows.column("norms")[own].as_py(), np.int64)
        asked: dict = {}
        for i, term in enumerate(col["term"]):
            if term == IDS:
                continue
            entry = col["w"][i], col["top"][i], Postings(col["last"][i], col["peak"][i], col["ends"][i], col["body"][i], norms)
            for item in col["items"][i]:
                asked.setdefault(item, []).append(entry)
        out = [], [], []
        for item, lists in asked.items():
            best, score = top_documents(lists, len(ids), k)
            out[0].extend([item] * len(best))
            out[1].extend(ids[d] for d in best)
            out[2].extend(score.tolist())
        return pa.table([pa.array(out[0], item_kind), pa.array(out[1], id_kind), pa.array(out[2], pa.int64())], names=["item", "doc", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_col, rank (int, from 1), id_col and score of the k best documents of each query.

    * null or empty texts, texts without a term: no document, and no query.
    * equal scores: ascending ids, nulls last; repeated rows of ``docs`` are documents of their own.
    * repeated item ids (a null one, too) are one query with the terms of all their texts.
    * very long texts: a shard of their own, hashed in pieces.
    * an empty table gives an empty result; other columns are ignored and may have any name.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ranked")
    corpus = corpus_of(docs, text_col)
    item_type, id_type = items.schema[item_col].dataType, docs.schema[id_col].dataType
    if not corpus.terms:
        return spark.createDataFrame([], f"{item_col} {item_type.simpleString()}, rank int, {id_col} {id_type.simpleString()}, score long")
    lists = scratch.keep(index(docs, corpus, id_col, text_col), "index")
    wanted = scratch.keep(query_terms(items, item_col, item_text), "queries")
    blocks = max(1, -(-wanted.select("item").distinct().count() // QUERY_BLOCK))
    spread = lists.select("term", "df").join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))

    @F.udf("long")
    def weight(df):
        return corpus.weight(df)

    asked = (wanted.join(spread, "term").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
             .groupBy("term", "block").agg(F.first("df").alias("df"), F.collect_list(F.struct("item")).alias("s"))
             .select("term", "block", weight("df").alias("w"), F.col("s.item").alias("items")))
    ids = (wanted.select(F.lit(IDS).cast("long").alias("term"), F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
           .distinct().withColumn("w", F.lit(0).cast("long")).withColumn("items", F.array().cast(f"array<{item_type.simpleString()}>")))
    asked = scratch.keep(asked.unionByName(ids), "asked")
    met = lists.drop("df").join(asked, "term")
    kinds = to_arrow_type(item_type), to_arrow_type(id_type)
    heaps = met.groupBy("shard", "block").applyInArrow(
        _answers(k, *kinds), f"item {item_type.simpleString()}, doc {id_type.simpleString()}, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    best = heaps.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
