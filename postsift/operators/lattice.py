"""Segmentation of unspaced text by a lexicon (M1, D2): least-cost path over a word lattice.

The lattice of a text has a place before and behind every code point, and an edge for every
lexicon word at every place where it stands, found by an Aho-Corasick automaton with
overlapping hits.  A code point that is no word is an edge of its own with the cost of an
unknown one.  The words of the cheapest path are the segmentation; of equal paths the one
whose last word is longer wins, and so on backwards.

A code point that no lexicon word has parts the lattice: what lies between two of them is a run, and equal
runs of a slice of texts have the same path, which is looked for once.  The runs of a slice take their steps
together: one place of each of them at a time (``_paths``).

A lexicon has any size: it is cut into parts (``keywords.keyword_parts``), and a slice of texts passes
through the automata of its task one after another, in one stage.  A task holds one automaton at a time
and the edges of one slice, whatever the number of rows.  Nothing is shuffled.  Time grows with the
text and its edges.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .keywords import automaton, keyword_parts

SCALE = 1000        # costs are thousandths of a natural logarithm
TEXT_CHARS = 4 << 20        # characters of the texts whose edges a task holds
OUT_WORDS = 50_000          # words that leave a task together, but for the last text's
STEP_RUNS, STEP_CHARS = 32, 64      # runs that step together at least, but within the first places
FAR = 1 << 61               # more than any path of runs that step together costs


def learn_costs(tokens: DataFrame, token_col: str = "token", floor: int = 10) -> tuple[DataFrame, int]:
    """Lexicon (surface, cost) of the tokens that occur ``floor`` times or more, and the cost of an unknown
    code point.  A word's cost is floor(1000 ln((T + 1) / count)) with T all their occurrences; an
    unknown code point costs as much as a word with half an occurrence.  Null and empty tokens are none.  An empty
    table gives an empty lexicon."""
    from ..plans.tables import materialize

    counts = tokens.filter(F.length(token_col) > 0).groupBy(F.col(token_col).alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.filter(F.col("n") >= floor), "lexicon")
    total = (counts.agg(F.sum("n")).first()[0] or 0) + 1
    lexicon = counts.select("surface", F.floor(SCALE * F.log(F.lit(float(total)) / F.col("n"))).cast("long").alias("cost"))
    return lexicon, int(np.floor(SCALE * np.log(2.0 * total)))


def least_path(n: int, edges: np.ndarray, unknown: int) -> list[tuple[int, int, bool, int]]:
    """(start, end, known, cost) along the cheapest path over ``n`` code points; ``edges`` has rows (end, length,
    cost) in any order."""
    best, back = [0] * (n + 1), [(1, False, unknown)] * (n + 1)
    edges = edges[np.lexsort((-edges[:, 1], edges[:, 0]))].tolist()
    at = 0
    for end in range(1, n + 1):
        chosen, step = None, None
        single = False
        while at < len(edges) and edges[at][0] == end:
            _, length, cost = edges[at]
            at += 1
            single = single or length == 1
            if chosen is None or best[end - length] + cost < chosen:       # longer words come first
                chosen, step = best[end - length] + cost, (length, True, cost)
        if not single and (chosen is None or best[end - 1] + unknown < chosen):
            chosen, step = best[end - 1] + unknown, (1, False, unknown)
        best[end], back[end] = chosen, step
    out, end = [], n
    while end:
        length, known, cost = back[end]
        out.append((end - length, end, known, cost))
        end -= length
    return out[::-1]


def _pieces(batch: pa.RecordBatch, text_at: int, chars: int):
    """``batch`` in slices of at most about ``chars`` characters, one row at least."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(text_at)), 0).to_pylist()):
        if i > at and size + n > chars:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def _slots(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of ``counts``, one behind another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _paths(lengths: np.ndarray, edges: tuple, unknown: int) -> tuple:
    """The cheapest path of each run: (words of each run, length, known, cost), the last three for the words of all
    runs in order.  Run r has the places first[r] .. first[r] + lengths[r] with first[r] = sum(lengths[:r] + 1);
    ``edges`` are (end, length, cost), of equal ends the longest first.

    Runs step together as long as ``STEP_RUNS`` of them do (or within ``STEP_CHARS`` code points); the few longer ones, and
    runs whose costs could leave 64 bits, go one by one."""
    end, size, cost = edges
    first = np.cumsum(lengths + 1) - (lengths + 1)
    depth = _slots(lengths + 1)
    run = np.repeat(np.arange(len(lengths)), lengths + 1)
    n = len(depth)
    step, known, price, last = np.ones(n, np.int64), np.zeros(n, bool), np.full(n, unknown, np.int64), np.zeros(n, bool)
    limit = max(STEP_CHARS, int(np.sort(lengths)[-STEP_RUNS]) if len(lengths) >= STEP_RUNS else 0)
    most = max(abs(unknown), int(cost.max(initial=0)), -int(cost.min(initial=0)))
    together = (lengths <= limit) & (most * (limit + 1) < FAR)
    bounds = np.searchsorted(end, np.append(first, n))
    for r in np.flatnonzero(~together):
        e = slice(bounds[r], bounds[r + 1])
        for start, to, is_known, paid in least_path(int(lengths[r]), np.column_stack([end[e] - first[r], size[e], cost[e]]), unknown):
            at = first[r] + to
            last[at], step[at], known[at], price[at] = True, to - start, is_known, paid
    single = np.zeros(n, bool)
    single[end[size == 1]] = True
    best = np.where(depth == 0, 0, 2 * FAR)
    # places, and edges by the place where they end, of one depth lie together
    mine = np.flatnonzero(together[run[end]])
    small = np.uint16 if limit < 1 << 16 else np.int64
    mine = mine[np.argsort(depth[end[mine]].astype(small), kind="stable")]
    end, size, cost = end[mine], size[mine], cost[mine]
    places = np.flatnonzero(together[run])
    places = places[np.argsort(depth[places].astype(small), kind="stable")]
    deepest = int(depth[places[-1]]) if len(places) else 0
    edge_at = np.searchsorted(depth[end], np.arange(1, deepest + 2))
    place_at = np.searchsorted(depth[places], np.arange(1, deepest + 2))
    for p in range(deepest):
        e, here = slice(edge_at[p], edge_at[p + 1]), places[place_at[p]:place_at[p + 1]]
        if e.start < e.stop:
            to, length = end[e], size[e]
            sums = best[to - length] + cost[e]
            begins = np.flatnonzero(np.diff(to, prepend=-1))
            least = np.minimum.reduceat(sums, begins)
            group = np.cumsum(np.diff(to, prepend=-1) != 0) - 1
            hit = np.flatnonzero(sums == least[group])
            chosen = np.empty(len(begins), np.int64)
            chosen[group[hit[::-1]]] = hit[::-1]        # the longest of equal ones
            at = to[begins]
            best[at], step[at], known[at], price[at] = least, length[chosen], True, cost[e][chosen]
        alone = best[here - 1] + unknown
        other = ~single[here] & (alone < best[here])
        at = here[other]
        best[at], step[at], known[at], price[at] = alone[other], 1, False, unknown
    at = (first + lengths)[together & (lengths > 0)]
    while len(at):
        last[at] = True
        at = at - step[at]
        at = at[depth[at] > 0]
    words = np.flatnonzero(last)
    return np.bincount(run[words], minlength=len(lengths)), step[words], known[words], price[words]


def _of_chars(codes: np.ndarray, test) -> np.ndarray:
    """``test`` of each code point."""
    own, which = np.unique(codes, return_inverse=True)
    return np.array([test(chr(c)) for c in own], bool)[which]


def _codes(texts: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)


def _cut(texts: pa.Array, alphabet: np.ndarray, outside: str, find, unknown: int) -> tuple:
    """The words of ``texts`` (no nulls): (words of each text, surface, known, cost), the last three for the words of all
    texts in order: white space is left out, unknown letters and digits beside each other are one word, any other
    unknown code point is a word of its own.

    ``alphabet`` tells the code points of the lexicon, ``outside`` is none of them, and ``find`` gives the edges of a text."""
    bounds = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    codes = _codes(texts)
    n = len(codes)
    if not n:
        return np.zeros(len(texts), np.int64), pa.array([], pa.string()), pa.array([], pa.bool_()), pa.array([], pa.int64())
    data = pa.py_buffer("".join(texts.to_pylist()).encode())
    at_byte = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)])

    def surfaces_of(starts):
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at_byte[np.append(starts, n)].astype(np.int32)), data)

    inside = alphabet[codes]
    begins = np.ones(n + 1, bool)
    begins[1:n] = inside[1:] != inside[:-1]
    begins[bounds] = True
    starts = np.flatnonzero(begins[:n])
    starts = starts, inside[starts]
    runs = surfaces_of(starts[0]).filter(pa.array(starts[1])).dictionary_encode()
    own, which, starts = runs.dictionary, runs.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts[0][starts[1]]

    lengths = pc.utf8_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
    counts, size, known, cost = _paths(lengths, find(outside.join(own.to_pylist())), unknown)
    # the words of each run of the texts
    mine = counts[which]
    word = _slots(mine) + np.repeat((np.cumsum(counts) - counts)[which], mine)
    within = np.cumsum(size) - size - np.repeat(np.cumsum(lengths) - lengths, counts)
    at = np.repeat(starts, mine) + within[word]
    begins, is_known, costs = ~inside, np.zeros(n, bool), np.full(n, unknown, np.int64)
    begins[at], is_known[at], costs[at] = True, known[word], cost[word]

    starts = np.flatnonzero(begins)
    is_known, costs, codes = is_known[starts], costs[starts], codes[starts]
    joins = np.zeros(len(starts), bool)
    joins[~is_known] = _of_chars(codes[~is_known], str.isalnum)
    joins[1:] &= joins[:-1]
    joins[np.searchsorted(starts, bounds[:-1][np.diff(bounds) > 0])] = False
    joins[0] = False
    head = np.flatnonzero(~joins)
    costs, is_known, starts, codes = np.add.reduceat(costs, head), is_known[head], starts[head], codes[head]
    kept = is_known.copy()
    kept[~is_known] = ~_of_chars(codes[~is_known], str.isspace)
    rows = np.searchsorted(bounds, starts[kept], "right") - 1
    return np.bincount(rows, minlength=len(texts)), surfaces_of(starts).filter(pa.array(kept)), pa.array(is_known[kept]), pa.array(costs[kept])


def _segmenter(parts: list, unknown: int, names: list, text_at: int):
    """Function of Arrow batches: the words of each text by all ``parts`` (surfaces, costs) of the lexicon.

    A task holds one automaton at a time, the edges of a slice of texts, and the words of that slice."""
    def run(batches):
        first = np.cumsum([0, *[len(w) for w, _ in parts]])
        lengths = np.concatenate([pc.utf8_length(w).to_numpy(zero_copy_only=False) for w, _ in parts]).astype(np.int64)
        costs = np.concatenate([c.to_numpy(zero_copy_only=False) for _, c in parts]).astype(np.int64)
        filled = [p for p, (w, _) in enumerate(parts) if len(w)]
        alphabet = np.zeros(0x110000, bool)
        for p in filled:
            alphabet[_codes(parts[p][0])] = True
        outside = chr(np.flatnonzero(~alphabet)[0])
        # what is built for one automaton only is worth no large slice
        chars, made, held = TEXT_CHARS if len(filled) > 1 else -(-TEXT_CHARS // 4), None, None

        def find(text):
            nonlocal made, held
            found = [np.empty((0, 2), np.int32)]
            # the part whose automaton is there comes first
            for p in sorted(filled if text else [], key=lambda p: p != held):
                if p != held:
                    made = None
                    made, held = automaton(parts[p][0].to_pylist()), p
                found.append(np.fromiter(chain.from_iterable(made.iter(text)), np.int32).reshape(-1, 2) + np.array([1, first[p]], np.int32))
            end, word = np.concatenate(found).T.astype(np.int64)
            size, step = lengths[word], np.diff(end)
            if not ((step > 0) | ((step == 0) & (np.diff(size) < 0))).all():       # one automaton's hits are in order
                order = np.lexsort((-size, end))
                end, size, word = end[order], size[order], word[order]
            return end, size, costs[word]

        for b in batches:
            for piece in _pieces(b, text_at, chars):
                texts = piece.column(text_at)
                counts, surface, known, cost = _cut(pc.fill_null(texts, ""), alphabet, outside, find, unknown)
                null = texts.is_null().to_numpy(zero_copy_only=False)
                upto, done = np.concatenate([[0], np.cumsum(counts)]), 0
                struct = pa.StructArray.from_arrays([surface, known, cost], ["surface", "known", "cost"])
                while done < piece.num_rows:
                    to = min(piece.num_rows, max(done + 1, int(np.searchsorted(upto, upto[done] + OUT_WORDS))))
                    offsets = pa.array(upto[done:to + 1] - upto[done], pa.int32())
                    words = pa.ListArray.from_arrays(offsets, struct.slice(upto[done], upto[to] - upto[done]), mask=pa.array(null[done:to]))
                    yield pa.RecordBatch.from_arrays([*[piece.column(i).slice(done, to - done) for i in range(text_at)], words], names)
                    done = to

    return run


def segment_words(posts: DataFrame, lexicon: DataFrame, unknown: int, text_col: str = "text", out_col: str = "words",
                  part_bytes: int | None = None, part_rows: int | None = None) -> DataFrame:
    """``posts`` with ``out_col``: array of (surface, known, cost), the words of each whole text in order.

    * a null text has null words; an empty one, or one of white space, has none.
    * of repeated surfaces in the lexicon the cheapest counts; null and empty ones, and null costs, are none.
    * an empty lexicon leaves unknown words only; an empty table gives an empty result.
    * repeated rows are each kept; a column ``out_col`` of ``posts`` is replaced, other columns may have any name.

    The lexicon reaches the tasks through the driver, as Arrow columns of its parts."""
    cost = F.min("cost").cast("string")
    cheapest = lexicon.filter(F.col("cost").isNotNull()).groupBy("surface").agg(cost.alias("cost"))
    table, parts = keyword_parts(cheapest.select(F.col("surface").alias("keyword"), F.col("cost").alias("category")), part_bytes, part_rows)
    keep = [c for c in posts.columns if c != out_col]
    fields = [T.StructField(f"k{i}", posts.schema[c].dataType) for i, c in enumerate(keep)]
    rows = posts.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"))
    word = T.StructType([T.StructField("surface", T.StringType()), T.StructField("known", T.BooleanType()), T.StructField("cost", T.LongType())])
    schema = T.StructType([*fields, T.StructField("words", T.ArrayType(word))])
    have = []
    for part in range(parts):
        t = table.filter(F.col("part") == part).select("keyword", F.col("categories")[0].cast("long").alias("cost")).toArrow().combine_chunks()
        have.append(tuple(pa.concat_arrays([x.cast(kind) for x in t.column(name).chunks]) if len(t) else pa.array([], kind) for name, kind in (("keyword", pa.string()), ("cost", pa.int64()))))
    rows = rows.mapInArrow(_segmenter(have, unknown, schema.names, len(keep)), schema)
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("words").alias(out_col))


def surfaces(words) -> Column:
    """The surfaces of ``segment_words``' array, as the token array that ``tokens.base_forms`` and
    ``tokens.lexicon_join`` take."""
    return F.transform(words, lambda w: w["surface"])
