"""Keyword tables of any size against whole texts (J1) with multi-pattern automata.

The table is cut into parts of bounded size by a hash of the keyword.  For each part the
posts are read once: a task builds the part's Aho-Corasick automaton and runs every text through
it, in time that grows with the text and its hits but not with the number of keywords.
Hits may overlap or lie in each other.  Texts stay where they are read: only the kept columns and
the keywords found leave a task, and nothing is shuffled.
"""

from __future__ import annotations

from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialize
from .filters import LABEL_PREFIX

PART_BYTES = 4 << 20        # UTF-8 bytes of the keywords of one part (an automaton takes some 40 times that)
PART_ROWS = 200_000         # keywords of one part


def keyword_parts(keywords: DataFrame, part_bytes: int | None = None, part_rows: int | None = None) -> tuple[DataFrame, int]:
    """The distinct keywords (null and empty ones dropped) with their sorted distinct categories and
    a part number, and the number of parts, from one measurement of the table."""
    part_bytes, part_rows = part_bytes or PART_BYTES, part_rows or PART_ROWS
    kw = (keywords.filter(F.length("keyword") > 0).groupBy("keyword")
          .agg(F.array_sort(F.collect_set(F.struct(F.col("category")))).alias("c")))
    kw = materialize(kw.select("keyword", F.col("c.category").alias("categories")), "keywords")
    size = kw.agg(F.count(F.lit(1)), F.sum(F.octet_length("keyword"))).first()
    # a hash deals unevenly: a fifth is left free
    parts = max(1, -(-5 * size[0] // (4 * part_rows)), -(-5 * (size[1] or 0) // (4 * part_bytes)))
    return kw.withColumn("part", F.pmod(F.xxhash64("keyword"), F.lit(parts))), parts


def automaton(words: Sequence[str]):
    """The automaton of some distinct words; a hit gives (last place, number of the word)."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, w in enumerate(words):
        made.add_word(w, i)
    made.make_automaton()
    return made


def _matches(words: list, categories: list, names: list, text_at: int):
    """Function of Arrow batches: a row for each keyword found and each of its categories."""
    def run(batches):
        made = automaton(words)
        labels = pa.array(categories, pa.list_(pa.string()))
        surface = pa.array(words, pa.string())
        for b in batches:
            rows, found = [], []
            for row, text in enumerate(b.column(text_at)):
                text = text.as_py()
                if text:
                    hits = sorted({i for _, i in made.iter(text)})
                    rows += [row] * len(hits)
                    found += hits
            each = labels.take(pa.array(found, pa.int64()))
            owner = pa.array(range(len(found)), pa.int64()).take(pa.compute.list_parent_indices(each))
            row = pa.array(rows, pa.int64()).take(owner)
            columns = [b.column(i).take(row) for i in range(b.num_columns) if i != text_at]
            words_out = surface.take(pa.array(found, pa.int64()).take(owner))
            yield pa.RecordBatch.from_arrays([*columns, pa.compute.list_flatten(each), words_out], names)

    return run


def keyword_match(posts: DataFrame, keywords: DataFrame, keep: Sequence[str], text_col: str = "text",
                  part_bytes: int | None = None, part_rows: int | None = None) -> DataFrame:
    """J1 + P13 for a table (category, keyword) of any size: ``keep`` columns of ``posts``, category,
    keyword and label of every pair whose text contains the keyword.

    A post appears once per keyword and category, however often the keyword occurs in it.  Null
    and empty texts, and null and empty keywords, match nothing; a null category is a category.
    Repeated posts are matched each.  ``keep`` may hold the text column.

    The table's parts (``keyword_parts``) reach the tasks one after another through the driver,
    which never holds more than one part; a table within the bound is one part, and the posts
    are read once."""
    from pyspark.sql import types as T

    table, parts = keyword_parts(keywords, part_bytes, part_rows)
    source = posts.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    fields = [T.StructField(f"k{i}", posts.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, T.StructField("category", T.StringType()), T.StructField("keyword", T.StringType())])
    out = None
    for part in range(parts):
        rows = table.filter(F.col("part") == part).select("keyword", "categories").collect()     # bounded by part_bytes and part_rows
        words, categories = [r.keyword for r in rows], [list(r.categories) for r in rows]
        if not words:
            continue
        found = source.mapInArrow(_matches(words, categories, schema.names, len(keep)), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = posts.sparkSession.createDataFrame([], schema)
    named = out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "category", "keyword")
    return named.withColumn("label", F.concat(F.lit(LABEL_PREFIX), F.col("category")))
