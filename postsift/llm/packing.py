"""Best-fit packing by patterns and non-negative least squares (operator 11).

Documents become token sequences of at most ``capacity``; longer ones are cut into pieces of that
length, of which the first may be shorter.

1. One pass encodes every text, cuts it and writes its pieces (narrow rows).  Each task
   numbers its pieces of a length.
2. The histogram of the lengths (at most ``capacity`` counts) is all that the driver sees.
3. Patterns of two or three lengths that fill a sequence exactly are enumerated, and how often
   each is to be repeated is fitted to the histogram by non-negative least squares, with the
   error of a length measured in tokens: so short pieces, which fill any gap, are left over
   rather than long ones.  The solution, or a share of it, is rounded within what the
   histogram has, whichever leads to the fewest sequences.
4. What is left is packed best fit by falling length, by counts of equal sequences.
5. The plan is a table of runs (length, first rank, count) -> (sequence, offset), whose
   size depends on ``capacity`` and not on the data; a piece's rank among those of its
   length gives its place.  Ranks are a task's numbers plus the counts of the tasks before it,
   so a length that a third of all pieces have is no hot key.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe
from .memory import handing_back
from .scratch import Scratch

AT_ONCE = 24            # patterns with no length in common that join the fit in one step
SAME = 0.2              # of the largest gradient, for joining in the same step
MAX_STEPS = 48          # steps of the fit; more only refine it, whatever is packed
SHARES = 1.0, 0.9, 0.75, 0.5, 0.25      # of the fitted repeats, tried in rounding
TOLERANCE = 1e-7        # of the largest count, in the gradient


# ------------------------------------------------------------------ the plan (counts only)
def patterns(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of two or three lengths (0: none) with pieces that sum to ``capacity``."""
    have = counts > 0
    have[0] = False
    lengths = np.flatnonzero(have[:capacity])
    other = capacity - lengths
    two = lengths[(other >= lengths) & have[other]]
    first, second = np.meshgrid(lengths, lengths, indexing="ij")
    third = capacity - first - second
    three = (first <= second) & (third >= second)
    three &= have[np.maximum(third, 0)]
    return np.concatenate([np.stack([two, capacity - two, np.zeros_like(two)], 1),
                           np.stack([first[three], second[three], third[three]], 1)])


def fit(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares over an active set: columns (of ``columns``) and how often
    each is repeated, for the smallest sum of squared errors in tokens.  Patterns join the
    set by gradient, several with no length in common at a time as long as that helps, and
    leave it when their coefficient would fall below zero."""
    weight = np.arange(len(counts)) / (len(counts) - 1)
    goal = counts * weight
    chosen, x, rest = [], np.zeros(0), goal.copy()
    best, together = np.inf, AT_ONCE
    for _ in range(MAX_STEPS):
        gradient = (rest * weight)[columns].sum(1)
        gradient[chosen] = -np.inf
        most = gradient.max(initial=0)
        if most <= TOLERANCE * goal.max(initial=0):
            break
        near = np.flatnonzero(gradient >= SAME * most)
        near = near[np.argsort(-gradient[near], kind="stable")]
        taken, new = np.zeros(len(counts), bool), []
        for j in near:
            own = columns[j][columns[j] > 0]
            if not taken[own].any():
                taken[own] = True
                new.append(int(j))
                if len(new) == together:
                    break
        chosen, x = chosen + new, np.concatenate([x, np.zeros(len(new))])
        matrix = np.zeros((len(counts), len(chosen)))
        for slot in range(columns.shape[1]):
            np.add.at(matrix, (columns[chosen, slot], np.arange(len(chosen))), 1)
        matrix = matrix * weight[:, None]
        while len(chosen):
            normal = matrix.T @ matrix
            normal[np.diag_indices_from(normal)] += 1e-9 * np.trace(normal) / len(normal)
            aim = np.linalg.solve(normal, matrix.T @ goal)
            below = aim <= 0
            if not below.any():
                x = aim
                break
            step = (x[below] / np.maximum(x[below] - aim[below], 1e-300)).min()
            x = x + step * (aim - x)
            stays = ~(below & (x <= 1e-9 * max(1.0, x.max())))
            if stays.all():
                stays[np.argmin(np.where(below, x, np.inf))] = False
            chosen, x, matrix = [c for c, s in zip(chosen, stays) if s], x[stays], matrix[:, stays]
        rest = goal - matrix @ x
        error = float(rest @ rest)
        if error >= best * (1 - 1e-9):          # no gain: fewer at a time, and at last none
            if together == 1:
                break
            together = 1
        else:
            best = min(best, error)
    return np.array(chosen, np.int64), x


@dataclass
class Plan:
    """Groups of equal sequences: (lengths of the pieces in order, number of sequences)."""
    capacity: int
    groups: list = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.groups)

    def runs(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, offset), by length and rank: the pieces of a
        length from that rank on go to the sequences from that one on, at that offset."""
        out, rank, base = [], np.zeros(self.capacity + 1, np.int64), 0
        for lengths, n in self.groups:
            offset = 0
            for length in lengths:
                out.append((length, rank[length], base, offset))
                rank[length] += n
                offset += length
            base += n
        out.sort()
        return np.array(out, np.int64).reshape(-1, 4)


def best_fit(counts: np.ndarray, capacity: int) -> list:
    """Groups (lengths, number): best fit by falling length, counting equal sequences."""
    free: dict[int, list] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        room = length
        while left:
            room = next((r for r in range(room, capacity) if free.get(r)), None)
            if room is None:                                    # new sequences, each as full as it gets
                each = capacity // length
                for copies, n in ((each, left // each), (left % each, 1)):
                    if copies and n:
                        free.setdefault(capacity - copies * length, []).append(((length,) * copies, n))
                break
            lengths, n = free[room].pop()
            use = min(n, left)
            if n > use:
                free[room].append((lengths, n - use))
            free.setdefault(room - length, []).append((lengths + (length,), use))
            left -= use
            room = length
    return [g for groups in free.values() for g in groups]


def _rounded(columns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[list, np.ndarray]:
    """Groups of the fitted patterns in whole numbers, within ``counts``, and the pieces left."""
    left, groups = counts.copy(), []
    for i in np.argsort(-x, kind="stable"):
        own, copies = np.unique(columns[i][columns[i] > 0], return_counts=True)
        n = min(int(np.floor(x[i] + 0.5)), int((left[own] // copies).min()))
        if n > 0:
            left[own] -= n * copies
            groups.append((tuple(int(v) for v in np.repeat(own, copies)[::-1]), n))
    return groups, left


def plan(counts: np.ndarray, capacity: int) -> Plan:
    """Sequences for ``counts`` pieces of each length from 0 to ``capacity``.  The fitted repeats
    are rounded at each of the ``SHARES``; the rounding that needs the fewest sequences, with
    what it leaves packed best fit, is taken (the largest share on ties)."""
    left, whole = counts.astype(np.int64), []
    if left[capacity]:
        whole.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    columns = patterns(left, capacity)
    chosen, x = fit(columns, left) if len(columns) else (np.empty(0, np.int64), np.zeros(0))
    made = []
    for share in SHARES:
        groups, rest = _rounded(columns[chosen], share * x, left)
        made.append(Plan(capacity, whole + groups + best_fit(rest, capacity)))
    return min(made, key=lambda p: p.sequences)


# ------------------------------------------------------------------ jobs
def pieces(docs: DataFrame, vocabulary: ByteBpe, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length and ids_crc32 of every piece, the task that cut it and its
    number among the pieces of that length of the task; with ``keep_ids`` its ids, too."""
    @handing_back
    def run(batches):
        encode, task, seen = vocabulary.encoder(), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            owner, out, ids = [], [], []
            for row, text in enumerate(b.column(1)):
                tokens = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                start, n, piece = 0, len(tokens) % capacity or capacity, 0
                while start < len(tokens):
                    part = tokens[start:start + n]
                    owner.append(row)
                    out.append((piece, start, n, zlib.crc32(part.tobytes()), seen[n]))
                    if keep_ids:
                        ids.append(part.astype(np.int32))
                    seen[n] += 1
                    start, n, piece = start + n, capacity, piece + 1
            cols = np.array(out, np.int64).reshape(-1, 5)
            arrays = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(cols[:, 0].astype(np.int32)),
                      *[pa.array(np.ascontiguousarray(cols[:, i])) for i in range(1, 5)], pa.array(np.full(len(cols), task, np.int64))]
            if keep_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["id", "piece", "start", "length", "ids_crc32", "nth", "task"] + ["ids"] * keep_ids
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, nth long, task long" + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, vocabulary: ByteBpe, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece (from 0), start (its document's ids before it), length,
    ids_crc32, sequence_id (from 0, without gaps) and offset (its place in the sequence), with
    ``keep_ids`` also its ids.  A document is its text's ids and ``end_id``.

    * null and empty texts: one piece with the end id.
    * repeated rows and null ids: every row is packed; they are told apart by their task and number.
    * very long texts: cut into as many pieces as they need.
    * an empty table gives an empty result; other columns are ignored and may have any name.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    mine = scratch.keep(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = np.zeros(capacity + 1, np.int64)
    for r in mine.groupBy("length").agg(F.sum("n").alias("n")).collect():       # at most one row per length
        counts[r.length] = r.n
    runs = plan(counts, capacity).runs()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = mine.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    span = int(counts.max(initial=0)) + 1
    keys = runs[:, 0] * span + runs[:, 1]

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            sequence = runs[at, 2] + rank - runs[at, 1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(sequence), pa.array(runs[at, 3])], [*kept, "sequence_id", "offset"])

    kept = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kind = docs.schema[id_col].dataType.simpleString()
    out = ranked.select(*kept, "rank").mapInArrow(
        place, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sequences of a packing with ``keep_ids``: sequence_id, ids, and parts (id_col, piece,
    offset, length) in order.  A group is one sequence."""
    part = F.struct("offset", "piece", "length", F.col(id_col).alias("id"), "ids")
    g = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part), lambda a, b: (a["offset"] - b["offset"]).cast("int")).alias("p"))
    return g.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
                    F.transform("p", lambda x: F.struct(x["id"].alias(id_col), x["piece"].alias("piece"), x["offset"].alias("offset"),
                                                        x["length"].alias("length"))).alias("parts"))
