"""N-gram Jaccard join with a token-group matrix (operator 10).

Every document is the set of its shingles of ``width`` words (3 unless given); two documents link when
``den * |intersection| >= num * |union|``.  The join is exact and finds the connected
components of the links without listing the pairs inside a group of copies.

1. Equal sets collapse to one class, keyed by a 64-bit hash of the set.
2. Prefixes.  Of n tokens, linked sets share at least o(n) = ceil(n num / den), so the first
   n - o + j tokens of each, in one order of all tokens, share at least j.  A class emits that
   prefix by hash order with a j that grows with n (``common``).  The classes that have a
   token in their prefix are counted; of its prefix a class then drops the most frequent
   tokens, one less than any linked class is sure to share with it.  A token that is kept by
   one class only can meet nothing; classes with no other tokens, or with fewer than j that
   another class has, are finished.  So a passage
   that many documents share is dropped everywhere, and only near copies go on.
3. Candidates.  Linked classes share at least j of the prefix tokens that several classes have.
   These lists are some tenth of the token sets, so pairs are tried on them first; whole sets are
   made only of classes that are in a pair that passes, when they are compared.
4. Rounds.  In each, a kept token's leader is the class of its largest component, and among
   these the most typical one; a class of another component is compared with one of its
   tokens' leaders, and links join components.
5. Groups of the matrix: classes that kept tokens connect, cut into parts of about ``GROUP_TOKENS``
   tokens, the followers of a leader together.  The union of a group's prefix tokens is stored as rows (group, token).  A class
   asks the groups that have, at a kept token, a class of a larger component (by size, then
   by key), the equi-join of its prefix tokens with the unions counts how many it can share,
   and only groups whose count reaches j are opened: their classes' prefix tokens meet those
   of the asking classes, dealt in parts, and then the sets of the classes that this leaves.
6. Components of all links (``components.connected``).

A hot key costs nothing extra at any step: counts, minima and maxima are partial
aggregates, joins are split by AQE, and groups and their queries are of bounded size.  Near
copies that are joined already ask nothing of each other.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .hashing import set_key, shingle_set
from .scratch import Scratch, runtime_filters
from .memory import handing_back

GROUP_TOKENS = 1 << 20      # tokens in one group of the matrix (8 bytes each)
QUERY_TOKENS = 1 << 18      # tokens of the queries that meet a group in one call
SPARE = 2                   # a prefix has one token in so many more than it needs
ROUNDS = 2                  # comparisons with leaders before the groups are asked


def least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def common(n: int, num: int, den: int) -> int:
    """j: tokens that the prefix of a set of n has in common with that of any linked set that is
    not smaller.  It does not fall with n."""
    o = least_overlap(n, num, den)
    return max(1, min(o, 1 + (n - o + 1) // SPARE))


def prefix(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """The prefix that a sorted token set emits."""
    n = len(s)
    return s[:n - least_overlap(n, num, den) + common(n, num, den)] if n else s


def shared_at_least(n: int, num: int, den: int) -> int:
    """Tokens that the prefixes of a set of n and of any linked set share."""
    return common(max(1, least_overlap(n, num, den)), num, den)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if len(values) else np.empty(0, np.int64)))


def signed_sets(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, width: int) -> DataFrame:
    """For each document id, n (set size) and cid (class key; null when empty); for the first
    document of a class in a task also least (``shared_at_least``) and the prefix."""
    kind = docs.select(F.col(id_col).alias("id")).schema["id"]

    @handing_back
    def run(batches):
        seen: set = set()
        for b in batches:
            n, cid, least, first = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), width)
                key = set_key(s) if len(s) else None
                fresh = key is not None and key not in seen
                seen.add(key)
                n.append(len(s))
                cid.append(key)
                least.append(shared_at_least(len(s), num, den) if fresh else None)
                first.append(prefix(s, num, den).view(np.int64) if fresh else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(least, pa.int64()),
                                              pa.array(first, pa.list_(pa.int64()))], ["id", "n", "cid", "least", "prefix"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind.dataType.simpleString()}, n long, cid long, least long, prefix array<long>")


def token_sets(docs: DataFrame, width: int) -> DataFrame:
    """cid and sorted tokens of the texts that have any."""
    @handing_back
    def run(batches):
        for b in batches:
            sets = [s for s in (shingle_set(t.as_py(), width) for t in b.column(0)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), _lists(sets)], ["cid", "tokens"])

    return docs.select("text").mapInArrow(run, "cid long, tokens array<long>")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """Edges of a spanning forest of the given ones."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            out[0].append(x)
            out[1].append(y)
    return out


def _by_token(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the lists in order, and the place of the list that each is of."""
    tokens = np.concatenate([np.asarray(t) for t in lists])
    owner = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
    order = np.argsort(tokens, kind="stable")
    return tokens[order], owner[order]


def _owners(tokens: np.ndarray, owner: np.ndarray, lo: np.ndarray, seen: np.ndarray, count: int) -> np.ndarray:
    """How many of the stretches of ``tokens`` (from ``lo``, ``seen`` long) each of ``count`` lists has."""
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(seen)[:-1]]), seen) + np.arange(seen.sum())
    return np.bincount(owner[at], minlength=count)


def meet_group(num: int, den: int):
    """Function of one group's classes and a part of its queries, both with their prefix tokens: the
    classes and the queries that are in a pair of other components that shares enough of them."""
    def run(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        met, asking = np.zeros(len(members), bool), np.zeros(len(queries), bool)
        if len(members) and len(queries):
            sizes, least, stars = (members[c].to_numpy() for c in ("n", "least", "star"))
            tokens, owner = _by_token(members["tokens"])
            for i, (star, n, enough, own) in enumerate(zip(queries["xstar"], queries["xn"], queries["xleast"], queries["xtokens"])):
                own = np.asarray(own)
                lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
                both = _owners(tokens, owner, lo, hi - lo, len(sizes))
                fits = (np.minimum(sizes, n) * den >= np.maximum(sizes, n) * num) & (stars != star)
                hits = fits & (both >= np.maximum(least, enough))
                met |= hits
                asking[i] = hits.any()
        cid = np.concatenate([members["cid"].to_numpy()[met], queries["x"].to_numpy()[asking]]).astype("int64")
        at = {c: np.full(len(cid), k, "int64") for c, k in zip(("gl", "gp", "deal"), key)}
        return pd.DataFrame({**at, "cid": cid, "asking": np.arange(len(cid)) >= met.sum()})

    return run


def open_group(num: int, den: int):
    """Function of one group's classes and a part of its queries: edges that join the
    stars of linked classes (a spanning forest of them)."""
    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        stars_a, stars_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(members) and len(queries):
            sizes = members["n"].to_numpy()
            cids, stars = members["cid"].to_numpy(), members["star"].to_numpy()
            tokens, owner = _by_token(members["tokens"])
            for x, star, n, own in zip(queries["x"], queries["xstar"], queries["xn"], queries["xtokens"]):
                own = np.asarray(own)
                lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
                seen = hi - lo
                # overlap with the union of the other classes bounds that with each of them
                others = seen - (1 if (cids == x).any() else 0)
                if den * np.count_nonzero(others > 0) < num * n:
                    continue
                lo, seen = lo[seen > 0], seen[seen > 0]
                both = _owners(tokens, owner, lo, seen, len(sizes))
                links = (den * both >= num * (sizes + n - both)) & (stars != star)
                linked = np.unique(stars[links])
                stars_a.append(np.full(len(linked), star))
                stars_b.append(linked)
        a, b = _forest(np.concatenate(stars_a), np.concatenate(stars_b))
        return pd.DataFrame({"a": np.array(a, "int64"), "b": np.array(b, "int64")})

    return run


def _linked(n: Column, tokens: Column, other_n: Column, other: Column, num: int, den: int) -> Column:
    both = F.size(F.array_intersect(tokens, other)).cast("long")
    return both * den >= (n + other_n - both) * num


def _with_components(near: DataFrame, edges: DataFrame | None, scratch: Scratch) -> DataFrame:
    """``near`` with comp (smallest class of the component) and size (its classes)."""
    if edges is None:
        return near.withColumn("comp", F.col("cid")).withColumn("size", F.lit(1).cast("long"))
    roots = scratch.keep(connected(edges, scratch), "comps")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    known = roots.join(sizes, "root").select(F.col("node").alias("cid"), F.col("root").alias("comp"), "size")
    return (near.join(known, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
            .withColumn("size", F.coalesce("size", F.lit(1).cast("long"))))


def _fits(n0: Column, n1: Column, n: Column, num: int, den: int) -> Column:
    """Some size from n0 to n1 can link with n."""
    return (n1 * den >= n * num) & (n0 * num <= n * den)


def _leaders(near: DataFrame, num: int, den: int) -> DataFrame:
    """cid and leader: for classes with a kept token whose leader is of another component and of
    a size that can link, the leader with most tokens among those that share several."""
    top = near.groupBy("token").agg(F.max(F.struct("size", "w", "cid", "comp", "n")).alias("t"))
    asked = near.join(top, "token").filter((F.col("comp") != F.col("t.comp")) & _fits(F.col("t.n"), F.col("t.n"), F.col("n"), num, den))
    pairs = asked.groupBy("cid", F.col("t.cid").alias("leader"), F.col("t.w").alias("lw")).agg(F.count(F.lit(1)).alias("k"))
    best = pairs.groupBy("cid").agg(F.max(F.struct(F.least("k", F.lit(3)).alias("some"), "lw", "k", "leader")).alias("best"))
    return best.select("cid", F.col("best.leader").alias("leader"), F.col("best.k").alias("k"))


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """cid, tokens and n of the classes ``wanted``.  One document of each gives the token set; the id
    only narrows the texts down, the set itself says which class it is."""
    who = scratch.keep(rows.filter("cid is not null").join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min("id").alias("wid"), F.max("n").alias("n")), "who")
    with runtime_filters(docs.sparkSession):
        ids = who.filter("n > 0").select("wid")
        texts = docs.join(ids, docs["id"].eqNullSafe(ids["wid"]), "left_semi")
        once = token_sets(texts, width).groupBy("cid").agg(F.first("tokens").alias("tokens"))
        sets = scratch.keep(once.join(who.drop("wid"), "cid"), "sets")
    scratch.drop(who)
    return sets


def _classes_linked(docs: DataFrame, signed: DataFrame, rows: DataFrame, scratch: Scratch, num: int, den: int, width: int) -> DataFrame:
    """(node, root) of the classes that link with another class."""
    spark = docs.sparkSession
    classes = (signed.filter("prefix is not null").groupBy("cid")
               .agg(F.any_value("n").alias("n"), F.any_value("least").alias("least"), F.any_value("prefix").alias("prefix")))
    classes = scratch.keep(classes, "classes")
    scratch.drop(signed)

    # tokens that several classes have in their prefixes, and of these the ones that a class keeps
    each = scratch.keep(classes.select("cid", "n", "least", F.size("prefix").alias("m"), F.explode("prefix").alias("token")), "each")
    scratch.drop(classes)
    often = scratch.keep(each.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "often")
    by = Window.partitionBy("cid")
    with runtime_filters(spark):
        met = each.join(often.filter("c > 1"), "token").withColumn("nth", F.row_number().over(by.orderBy("c", "token"))).withColumn("k", F.count(F.lit(1)).over(by))
        met = scratch.keep(met.filter("k >= least").select("cid", "n", "least", "token", (F.col("nth") <= F.col("m") - F.col("least") + 1 - (F.col("m") - F.col("k"))).alias("kept")), "met")
    scratch.drop(each, often)
    kept = met.filter("kept").select("cid", "n", "token")
    near = kept.join(kept.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token"), "token")
    near = scratch.keep(near, "near")
    near = scratch.keep(near.join(near.groupBy("cid").agg(F.count(F.lit(1)).alias("w")), "cid"), "near")

    # what the classes that go on have in common with any other: enough to leave most pairs out
    going = near.select("cid").distinct()
    lists = scratch.keep(met.join(going, "cid", "left_semi").groupBy("cid").agg(F.max("least").alias("least"), F.sort_array(F.collect_list("token")).alias("tokens")), "lists")

    # rounds: classes that link with a leader join its component
    edges, first_led, comps = None, None, _with_components(near, None, scratch)
    for _ in range(ROUNDS):
        led = scratch.keep(_leaders(comps, num, den), "led")
        first_led = first_led if first_led is not None else led
        asks = led.filter("k > 0")
        leads = lists.select(F.col("cid").alias("leader"), F.col("least").alias("enough"), F.col("tokens").alias("lead"))
        shared = F.size(F.array_intersect("tokens", "lead"))
        with runtime_filters(spark):
            asks = scratch.keep(asks.join(lists, "cid").join(leads, "leader").filter(shared >= F.greatest("least", "enough")).select("cid", "leader", "k"), "tries")
        sets = _sets(docs, rows, asks.select("cid").unionByName(asks.select(F.col("leader").alias("cid"))).distinct(), scratch, width)
        leads = sets.select(F.col("cid").alias("leader"), F.col("n").alias("ln"), F.col("tokens").alias("lead"))
        tried = asks.filter("k > 0").join(sets, "cid").join(leads, "leader").filter(_linked(F.col("n"), F.col("tokens"), F.col("ln"), F.col("lead"), num, den))
        new = tried.select(F.col("cid").alias("a"), F.col("leader").alias("b"))
        with runtime_filters(spark):
            new = scratch.keep(new, "edges")
        scratch.drop(asks, sets)
        edges = new if edges is None else edges.unionByName(new)
        comps = scratch.keep(_with_components(near, edges, scratch), "near")

    # groups: what kept tokens connect, in parts of bounded size, so that a token has classes in the
    # parts of one family only; a leader with many followers is cut by class
    tops = near.groupBy("token").agg(F.max(F.struct("w", "cid")).alias("t"))
    ties = near.join(tops, "token").select(F.col("cid").alias("a"), F.col("t.cid").alias("b")).filter("a <> b").distinct()
    families = scratch.keep(connected(ties, scratch), "families")
    of = (comps.select("cid", "n", "comp", "size").distinct().join(first_led.drop("k"), "cid", "left").withColumn("leader", F.coalesce("leader", "cid"))
          .join(families.withColumnsRenamed({"node": "cid", "root": "family"}), "cid", "left").withColumn("family", F.coalesce("family", "cid")))
    of = scratch.keep(of, "of")
    mass = of.groupBy("leader").agg(F.sum("n").alias("mass"), F.min("family").alias("family"))
    large = F.col("mass") > GROUP_TOKENS
    parts = mass.groupBy("family").agg(F.ceil(F.sum(F.when(~large, F.col("mass"))) / GROUP_TOKENS).alias("parts"))
    placed = of.join(mass.drop("family"), "leader").join(parts, "family")
    own = F.ceil(F.col("mass") / GROUP_TOKENS)
    group = F.when(large, F.struct(F.col("leader").alias("gl"), (-1 - F.pmod(F.xxhash64("cid"), own)).alias("gp"))).otherwise(
        F.struct(F.col("family").alias("gl"), F.pmod(F.xxhash64("leader"), F.col("parts")).alias("gp")))
    place = scratch.keep(placed.select("cid", "n", "comp", "size", group.alias("g")).select("cid", "n", "comp", "size", "g.gl", "g.gp"), "place")
    scratch.drop(of, families)

    # the matrix: at a kept token, the groups with a class of a larger component are asked
    at = comps.select("token", "cid").join(place, "cid")
    cells = at.groupBy("token", "gl", "gp").agg(F.max(F.struct("size", "comp")).alias("top"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    larger = (F.col("top.size") > F.col("size")) | ((F.col("top.size") == F.col("size")) & (F.col("top.comp") > F.col("comp")))
    asks = (at.drop("gl", "gp").join(cells, "token").filter(larger & _fits(F.col("n0"), F.col("n1"), F.col("n"), num, den))
            .select("cid", "n", "gl", "gp").distinct())
    asks = scratch.keep(asks, "asks")
    union = met.select("cid", "token").join(place.select("cid", "gl", "gp"), "cid").select("gl", "gp", "token").distinct()
    with runtime_filters(spark):
        mine = scratch.keep(asks.filter("n > 0").drop("n").join(met.select("cid", "least", "token"), "cid"), "mine")
    shares = mine.join(union, ["gl", "gp", "token"])
    asks = scratch.keep(shares.groupBy("cid", "gl", "gp").agg(F.count(F.lit(1)).alias("k"), F.max("least").alias("least"))
                        .filter("k >= least").select("cid", "gl", "gp").join(place.select("cid", "n"), "cid"), "asks")
    loads = scratch.keep(asks.groupBy("gl", "gp").agg(F.ceil(F.sum("n") / QUERY_TOKENS).alias("deals")), "loads")
    known = place.select("cid", "gl", "gp", F.col("comp").alias("star"), "n").join(lists, "cid")
    with runtime_filters(spark):
        q = (asks.filter("n > 0").select("cid", "gl", "gp").join(known.drop("gl", "gp"), "cid").join(loads, ["gl", "gp"])
             .select("gl", "gp", F.pmod(F.xxhash64("cid"), F.col("deals")).alias("deal"), "cid", "star", "n", "least", "tokens"))
        m = (known.join(loads.filter("deals > 0"), ["gl", "gp"])
             .select("gl", "gp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), "cid", "star", "n", "least", "tokens"))
        picked = scratch.keep(_met(m, q, num, den), "picked")
    sets = _sets(docs, rows, picked.select("cid").distinct(), scratch, width)
    with runtime_filters(spark):
        full = (picked.join(place.select("cid", F.col("comp").alias("star")), "cid").join(sets, "cid")
                .select("gl", "gp", "deal", "cid", "star", "n", "tokens", "asking"))
        found = scratch.keep(_opened(full.filter("not asking").drop("asking"), full.filter("asking").drop("asking"), num, den), "found")
    out = scratch.keep(connected(edges.unionByName(found), scratch), "roots")
    scratch.drop_others(out, rows)
    return out


def _met(m: DataFrame, q: DataFrame, num: int, den: int) -> DataFrame:
    """gl, gp, deal, cid and asking: in each part of a group's queries, the classes and queries that are compared."""
    m = m.toDF("ml", "mp", "md", "cid", "star", "n", "least", "tokens")
    q = q.toDF("ql", "qp", "qd", "x", "xstar", "xn", "xleast", "xtokens")
    return (m.groupBy("ml", "mp", "md").cogroup(q.groupBy("ql", "qp", "qd"))
            .applyInPandas(meet_group(num, den), "gl long, gp long, deal long, cid long, asking boolean"))


def _opened(m: DataFrame, q: DataFrame, num: int, den: int) -> DataFrame:
    """Edges of all groups with the queries that meet them."""
    m = m.toDF("ml", "mp", "md", "cid", "star", "n", "tokens")
    q = q.toDF("ql", "qp", "qd", "x", "xstar", "xn", "xtokens")
    return (m.groupBy("ml", "mp", "md").cogroup(q.groupBy("ql", "qp", "qd"))
            .applyInPandas(open_group(num, den), "a long, b long"))


def _components(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, n, cid) of every document, and (node, root) of the linked classes."""
    signed = scratch.keep(signed_sets(docs, id_col, text_col, num, den, width), "signed")
    rows = scratch.keep(signed.select("id", "n", "cid"), "rows")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows, _classes_linked(plain, signed, rows, scratch, num, den, width)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       num: int = 90, den: int = 100, width: int = 3) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, and root (key of the
    component; null for an empty set).

    * null text, no words: n_shingles 0, component_id is the document's own id.
    * repeated rows: each is kept; equal texts are in one component.
    * null ids: the component id is the smallest non-null id in it, null if there is none.
    * other columns of ``docs`` are ignored and may have any name.
    * an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    signed, roots = _components(docs, id_col, text_col, num, den, width, scratch)
    classes = signed.filter(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("id").alias("least"))
    linked = roots.join(classes, roots["node"] == classes["cid"]).select("node", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    of_class = (classes.join(linked.join(least, "root").select(F.col("node").alias("cid"), "root", "component"), "cid", "left")
                .select(F.col("cid").alias("key"), F.coalesce("root", "cid").alias("root"),
                        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component")))
    out = signed.select("id", "n", "cid").join(of_class, F.col("cid") == F.col("key"), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"), "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             num: int = 90, den: int = 100, width: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of linked documents
    does: the one with the smallest id (null ids last, the smallest text on ties).  Rows
    without words are linked with nothing and all stay; columns stay as they are."""
    scratch = Scratch(docs.sparkSession, "keep")
    signed, roots = _components(docs, id_col, text_col, num, den, width, scratch)
    rows = signed.filter("cid is not null").select("id", "cid").join(roots, F.col("cid") == F.col("node"), "left")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "cid")
    first = (rows.groupBy(F.coalesce("root", "cid").alias("root")).agg(F.min(rank).alias("w"))
             .select(F.col("w.id").alias("wid"), F.col("w.cid").alias("wcid")))
    first = scratch.keep(first, "first")

    @F.pandas_udf("long")
    def key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        @handing_back
        def run(batches):
            for texts in batches:
                sets = (shingle_set(t, width) for t in texts)
                yield pd.Series([set_key(s) if len(s) else None for s in sets], dtype="Int64")

        yield from run(batches)

    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), key(F.col(text_col)).alias("cid"))
    # one shuffle of the texts serves the join and the choice among repeated rows
    mine = keyed.join(first, keyed["id"].eqNullSafe(first["wid"]) & (keyed["cid"] == first["wcid"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("id", "cid").orderBy(F.col("row")[text_col]))
    kept = mine.withColumn("nth", nth).filter("nth = 1").select("row")
    return kept.unionByName(keyed.filter(F.col("cid").isNull()).select("row")).select("row.*")
