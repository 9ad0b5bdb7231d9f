"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the whole given
tables (stand-ins per SURVEY §7.3).  Output column names equal the oracle's."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import ascii_lower, clean_text, normalized, scrape_clean, tidy_text
from ..functions.tokens import DEFAULT_LEXICON, base_forms, join_tokens, lexicon_join, tokenize
from ..functions.words import kept_words
from ..operators import aggregate, dedupe, filters, grams, joins, keywords, lattice, linear, naive_bayes, ngram_model, segment, union
from ..session import free_shuffles, remove_scratch, scratch_path, shuffles_removed
from ..sources import csv_files, html, json_posts
from ..sinks import batches, writers
from ..streaming import cursor, ingest
from .tables import materialize, spread_for_cpu, table

# Parameters of the registered queries.
ZONE = "Asia/Tokyo"                 # local zone for F37 rendering
TARGET_CLASS = "q1"                 # stand-in for the reference's target class
CAP_PER_USER = 50                   # W2/L1 cap of the short per-user list
SEARCH_CAP, TIMELINE_CAP, TRAINING_CAP = 10_000, 5_000, 3_000   # caps of the reference's searches and timelines
USER_SPAN = 160                     # consecutive documents of a source that stand for one user's posts
LANG_TARGET = "en"                  # target class of the segmentation (classes: languages)
SINCE = datetime.datetime(2024, 1, 10)
SEARCH = dict(keyword="the", min_faves=100, lang="en")
VOCAB_FLOOR = 10                    # occurrences of a word of the segmentation's lexicon
KEYWORD_DF = (3, 30)                # documents that hold a word of the keyword table
MIN_FAVES = 10                      # P9 popularity floor of the scraper path
# Stand-in dictionary for J1 on the given tables (the reference's own dictionary,
# `joins.REFERENCE_KEYWORDS`, is Japanese and matches nothing in them).
DATA_KEYWORDS = {"en": ["the", "and"], "fr": ["les", "que"], "de": ["und", "der"], "es": ["los", "por"]}
ASCII_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123)]))
WIDE_LETTERS = "".join(chr(ord(c) + 0xFEE0) for c in ASCII_LETTERS)
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _t(spark, sf, name):
    return table(spark, sf, name)


def _text(spark, sf, name, *cols):
    """A text table pruned to ``cols`` and spread over the cores for per-row CPU work."""
    return spread_for_cpu(_t(spark, sf, name).select(*cols))


def _ts(c):
    return F.date_format(F.col(c), TS_FMT)


def with_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """clean -> tokenize -> lexicon/keep-list/base form (one projection)."""
    return df.withColumn("words_arr", kept_words(text_col)).withColumn("words", join_tokens("words_arr"))


def labelled_docs(spark, sf) -> DataFrame:
    labels = _t(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("label"))
    return _text(spark, sf, "documents", "doc_id", "text").join(labels, "doc_id")


_saved: dict[tuple, str] = {}


def nb_model(spark, sf, fresh: bool = False):
    """The classifier of the labelled documents, fitted and saved once per session and set of
    input files (paths and times) and loaded by every query that scores with it (``fresh``: fitted and saved anew)."""
    stored = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").cast("string").alias("time"))
    files = [_t(spark, sf, t).select(stored.alias("f")).distinct() for t in ("documents", "labels")]
    key = (spark.sparkContext.applicationId, *sorted(tuple(r.f) for r in files[0].unionByName(files[1]).collect()))
    if fresh or key not in _saved:
        path = scratch_path(spark, "nb-model")
        naive_bayes.save_nb(naive_bayes.fit_nb(with_words(labelled_docs(spark, sf)), "label", "words_arr"), path)
        _saved[key] = path
    return naive_bayes.load_nb(spark, _saved[key])


def nb_scored(spark, sf, carry=(), fresh: bool = False) -> DataFrame:
    model = nb_model(spark, sf, fresh)
    docs = with_words(_text(spark, sf, "documents", "doc_id", "text", *carry))
    return naive_bayes.score_nb(model, docs, "doc_id", "words_arr", "words", carry=carry)


# ------------------------------------------------------------------ text
def q_clean_documents(spark, sf):
    return _text(spark, sf, "documents", "doc_id", "text").select("doc_id", clean_text("text").alias("clean_text"))


def q_clean_pages(spark, sf):
    return _text(spark, sf, "pages", "page_id", "html").select("page_id", clean_text("html").alias("clean_text"))


def q_scrape_clean(spark, sf):
    return _text(spark, sf, "pages", "page_id", "html").select("page_id", scrape_clean("html").alias("text"))


def q_nfkc_documents(spark, sf):
    """Texts in full-width letters, which NFKC turns into plain ones."""
    d = _text(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", normalized(F.translate("text", ASCII_LETTERS, WIDE_LETTERS)).alias("text_nfkc"))


def q_tidy_output(spark, sf):
    d = _t(spark, sf, "documents")
    out = d.select(F.col("doc_id").alias("tweet_id"), F.col("source").alias("screen_name"),
                   tidy_text("text").alias("text"))
    return filters.stringify(out)


def q_html_links(spark, sf):
    return html.page_links(_text(spark, sf, "pages", "page_id", "html"))


# ------------------------------------------------------------------ parsing
def q_parse_created_at(spark, sf):
    e = _t(spark, sf, "events").select("event_id", parse.api_time_text("ts").alias("created_at_text"))
    return e.select("event_id", "created_at_text",
                    parse.api_time_to_local_minute("created_at_text", ZONE).alias("local_minute"))


def q_parse_jp_time(spark, sf):
    e = _t(spark, sf, "events").select("event_id", parse.scrape_time_text("ts").alias("jp_text"))
    return e.select("event_id", "jp_text", parse.scrape_time_to_minute("jp_text").alias("minute"))


def q_parse_counts(spark, sf):
    o = _t(spark, sf, "orders")
    txt = F.concat(F.lit("<span>"), F.format_number(F.floor("o_totalprice"), 0), F.lit(parse.LIKE_SUFFIX), F.lit("</span>"))
    o = o.select("o_orderkey", txt.alias("count_text"))
    return o.select("o_orderkey", "count_text", parse.count_text_to_long("count_text").alias("favorites"))


# ------------------------------------------------------------------ JSON sources
def event_posts_raw(spark, sf) -> DataFrame:
    """Search pages landed from `events`: one page per event.  Clicks carry a
    `retweeted_status` object, views the key with a null value, others no key."""
    e = _t(spark, sf, "events")
    user = F.struct(F.col("user_id").cast("string").alias("id_str"),
                    F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("screen_name"),
                    F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"),
                    (F.col("user_id") * 100).alias("followers_count"))
    post = F.struct(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("id_str"),
                    parse.api_time_text("ts").alias("created_at"), F.col("props").alias("full_text"),
                    F.length("props").cast("bigint").alias("retweet_count"),
                    F.floor("value").cast("bigint").alias("favorite_count"), F.lit("ja").alias("lang"),
                    user.alias("user"))
    plain = F.to_json(post)
    rt = F.to_json(F.struct(*[post[f] for f in ["id", "id_str", "created_at", "full_text", "retweet_count",
                                                  "favorite_count", "lang", "user"]],
                            F.struct((F.col("event_id") - 1).alias("id")).alias("retweeted_status")))
    # the null-valued key (to_json drops null fields): spliced into the object text
    nul_post = F.regexp_replace(plain, r"\}$", ',"retweeted_status":null}')
    raw_post = (F.when(F.col("event_type") == "click", rt)
                 .when(F.col("event_type") == "view", nul_post).otherwise(plain))
    page = F.concat(F.lit('{"statuses":['), raw_post, F.lit("]}"))
    return e.select("event_id", page.alias("page"))


def _flat_events(spark, sf):
    pages = event_posts_raw(spark, sf)
    posts = json_posts.flatten_posts(json_posts.explode_pages(pages, "page", "search"))
    return posts


def q_flatten_json(spark, sf):
    p = _flat_events(spark, sf)
    return p.select("tweet_id", "user_id", "screen_name", "user_name", "followers", "retweets", "favorites",
                    _ts("created_at").alias("created_at"), "text", "lang", "is_retweet")


def q_drop_retweets(spark, sf):
    p = _flat_events(spark, sf).filter(~F.col("is_retweet"))
    return p.select("tweet_id", "user_id", "screen_name", "favorites", _ts("created_at").alias("created_at"))


def q_only_text(spark, sf):
    p = _flat_events(spark, sf).filter(~F.col("is_retweet"))
    return filters.only_text(p)


def q_list_members(spark, sf):
    c = _t(spark, sf, "customer")
    member = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("screen_name"),
                                F.col("c_name").alias("name")))
    pages = c.select(F.col("c_nationkey").alias("list_id"), F.concat(F.lit('{"users":['), member, F.lit("]}")).alias("page"))
    return json_posts.flatten_users(json_posts.explode_pages(pages, "page", "list", keep=["list_id"]), keep=["list_id"])


def q_timeline_json(spark, sf):
    o = _t(spark, sf, "orders")
    post = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"),
                              parse.api_time_text("o_orderdate").alias("created_at"),
                              F.struct(F.col("o_custkey").cast("string").alias("id_str")).alias("user")))
    path = scratch_path(spark, "timeline")
    o.select(F.concat(F.lit("["), post, F.lit("]")).alias("value")).write.mode("overwrite").text(path)
    back = json_posts.flatten_posts(json_posts.read_pages(spark, path, "timeline"))
    return back.select("tweet_id", "user_id", "text", _ts("created_at").alias("created_at"))


# ------------------------------------------------------------------ conversations
def _conv_posts(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.withColumn("in_reply_to_turn", F.when(F.col("turn") > 0, F.col("turn") - 1))


def q_exclude_replies(spark, sf):
    p = filters.exclude_replies(_conv_posts(spark, sf), "in_reply_to_turn")
    return filters.select_by_name(p, ["conv_id", "turn", "role", "text"])


def q_retweeter_edges(spark, sf):
    c = _t(spark, sf, "conversations")
    parents = c.filter("turn = 0").select("conv_id", F.col("role").alias("parent_name"))
    rts = c.filter("turn > 0").select("conv_id", F.col("turn").alias("retweeter_turn"), F.col("role").alias("retweeter_name"))
    e = joins.retweeter_edges(parents, rts, "conv_id", "parent_name", "conv_id")
    return e.select(F.col("conv_id").alias("parent_id"), "retweeter_turn", "retweeter_name", "post_url")


def q_retweeters_json(spark, sf):
    """S4 + J3 + P13: retweeter pages landed per reply (bare arrays of {user}), read
    with the page reader, joined to the parent post for its link."""
    c = _t(spark, sf, "conversations")
    user = F.struct(F.concat(F.col("conv_id").cast("string"), F.lit("0"), F.col("turn").cast("string")).alias("id_str"),
                    F.col("role").alias("name"), F.concat(F.col("role"), F.col("turn").cast("string")).alias("screen_name"))
    pages = c.filter("turn > 0").select("conv_id", F.concat(F.lit("["), F.to_json(F.struct(user.alias("user"))), F.lit("]")).alias("page"))
    rts = json_posts.flatten_retweeters(json_posts.explode_pages(pages, "page", "retweeters", keep=["conv_id"]), keep=["conv_id"])
    parents = c.filter("turn = 0").select("conv_id", F.col("role").alias("parent_name"))
    e = joins.retweeter_edges(parents, rts, "conv_id", "parent_name", "conv_id")
    return e.select(F.col("conv_id").alias("parent_id"), "user_id", "user_name", "screen_name", "post_url")


def q_rotate_order(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    j = c.join(n, "conv_id")
    return j.select("conv_id", "turn", "n_turns", dedupe.rotate_positions(F.col("turn"), F.col("n_turns")).alias("seq"))


# ------------------------------------------------------------------ filters / joins
def q_search_predicate(spark, sf):
    d = _t(spark, sf, "documents")
    out = filters.search_predicate(d, faves_col="n_chars", **SEARCH)
    return out.select("doc_id", "source", "n_chars")


def q_keyword_label(spark, sf):
    d = _text(spark, sf, "documents", "doc_id", "text")
    return joins.keyword_label(d, DATA_KEYWORDS).select(
        "doc_id", "category", "keyword", "label")


def _keyword_table(spark, sf) -> DataFrame:
    """A keyword table from the documents' vocabulary: words of six characters and more that
    stand in ``KEYWORD_DF`` documents, in categories by their language and first letter."""
    d = _t(spark, sf, "documents").select("doc_id", "lang", F.explode(F.array_distinct(F.split("text", r"[^a-z]+"))).alias("keyword"))
    found = d.filter(F.length("keyword") >= 6).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.collect_set("lang").alias("langs"))
    found = found.filter(F.col("n").between(*KEYWORD_DF))
    return found.select(F.explode("langs").alias("lang"), "keyword").select(F.concat_ws("-", "lang", F.substr("keyword", F.lit(1), F.lit(1))).alias("category"), "keyword")


def q_keyword_table_label(spark, sf):
    """J1 with a table of thousands of keywords: one row per document and category, with how
    many of its keywords the document contains and the first and last of them."""
    hits = keywords.keyword_match(_text(spark, sf, "documents", "doc_id", "text"), _keyword_table(spark, sf), ["doc_id"])
    return hits.groupBy("doc_id", "category", "label").agg(F.count(F.lit(1)).alias("n_keywords"), F.min("keyword").alias("first_keyword"), F.max("keyword").alias("last_keyword"))


def q_lattice_words(spark, sf):
    """M1 by a lexicon: the documents with every other space between two words left out, cut into words by the
    lexicon of the documents' own words.  Per document the words of the lexicon, their characters, squared lengths
    (which tell one segmentation from another) and costs."""
    docs = _text(spark, sf, "documents", "doc_id", "text")
    lower = ascii_lower("text")
    tokens = docs.select(F.explode_outer(F.regexp_extract_all(lower, F.lit("[a-z]+"), 0)).alias("token"))
    lexicon, unknown = lattice.learn_costs(tokens, "token", VOCAB_FLOOR)
    joined = docs.select("doc_id", F.regexp_replace(lower, "([a-z]+) ([a-z]+)", "$1$2").alias("text"))
    known = F.filter("words", lambda w: w["known"])

    def total(value):
        return F.aggregate(known, F.lit(0).cast("long"), lambda a, w: a + value(w).cast("long"))

    length = lambda w: F.length(w["surface"])
    return lattice.segment_words(joined, lexicon, unknown).select(
        "doc_id", total(lambda w: F.lit(1)).alias("n_known"), total(length).alias("known_chars"),
        total(lambda w: length(w) * length(w)).alias("squares"), total(lambda w: w["cost"]).alias("cost"))


def _candidate_users(spark, sf):
    """The given user list: all customers."""
    return (_t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("screen_name"),
                    F.col("c_acctbal").alias("followers")))


def _order_posts(spark, sf):
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("tweet_id"), F.col("o_custkey").alias("user_id"),
                                           "o_orderdate", "o_totalprice")


def q_user_timeline(spark, sf):
    j = joins.user_timeline(_order_posts(spark, sf), _candidate_users(spark, sf), "user_id")
    return j.select("tweet_id", "user_id", "screen_name", "followers", _ts("o_orderdate").alias("created_at"))


def q_unresolved_users(spark, sf):
    """P12 report: listed users whose timeline lookup yields nothing (anti-join).  Protected
    posts are not in a timeline: orders that are not fulfilled stand for them."""
    visible = _t(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("user_id"))
    return joins.unresolved_users(_candidate_users(spark, sf), visible, "user_id").select("user_id", "screen_name")


def q_activity_floor(spark, sf):
    posts = _order_posts(spark, sf)
    active = aggregate.active_keys(posts, "user_id", "tweet_id")
    return joins.keep_keys(posts, active, "user_id").select("tweet_id", "user_id")


# ------------------------------------------------------------------ de-dup family
def _events(spark, sf):
    return _t(spark, sf, "events").select("event_id", "user_id", "event_type", "value", _ts("ts").alias("ts"))


def q_dedupe_first(spark, sf):
    return dedupe.dedupe_first(_events(spark, sf), ["user_id"], ["event_id"])


def q_dedupe_first_two_keys(spark, sf):
    return dedupe.dedupe_first(_events(spark, sf), ["user_id", "event_type"], ["event_id"])


def q_dedupe_last(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    o = union.fill_zero(o, ["o_custkey"])
    return dedupe.dedupe_last(o, ["o_custkey"], ["o_orderkey"])


def q_dedupe_then_min_faves(spark, sf):
    return dedupe.dedupe_then_filter(_events(spark, sf), ["user_id"], ["event_id"], F.col("value") >= MIN_FAVES)


def q_cap_per_query(spark, sf):
    """Newest ``CAP_PER_USER`` non-retweet posts per user, with the final rank."""
    e = _t(spark, sf, "events").filter(F.col("event_type") != "click").select("event_id", "user_id")
    e = dedupe.cap_per_key(e, ["user_id"], dedupe.newest_first("event_id"), CAP_PER_USER)
    return e.withColumn("rank", dedupe.row_number_in(["user_id"], dedupe.newest_first("event_id")).cast("bigint"))


def q_cap_per_search(spark, sf, cap: int = TRAINING_CAP):
    """L1 at the caps of the reference: the newest posts per search (few keys, each with a
    large part of all rows)."""
    e = _t(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", "a").otherwise("b").alias("search"))
    return dedupe.cap_per_key(e, ["search"], dedupe.newest_first("event_id"), cap)


def q_search_since(spark, sf):
    """P8 with all its parts on engagement posts."""
    e = _t(spark, sf, "events")
    out = filters.search_predicate(e, keyword="7", min_faves=10, since=SINCE, lang="view", text_col="props", faves_col="value",
                                   time_col="ts", lang_col="event_type")
    return out.select("event_id", "user_id", _ts("ts").alias("ts"))


def q_union_sources(spark, sf):
    c = _t(spark, sf, "customer").select(
        F.col("c_custkey").alias("Unnamed: 0"), F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("user_name"), F.col("c_acctbal").alias("followers"),
        F.col("c_mktsegment").alias("segment"), F.lit(1).alias("src_priority"))
    s = _t(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("user_name"),
        F.col("s_acctbal").alias("followers"), F.lit(2).alias("src_priority"))
    n = _t(spark, sf, "nation").select(F.col("n_name").alias("user_name"), F.col("n_nationkey").alias("user_id"), F.lit(3).alias("src_priority"))
    u = union.union_by_name([union.union_by_name([c, s]), n])      # U4: a union of unions
    u = union.fill_zero(u, ["user_id", "followers"])
    u = union.cast_columns(u, {"user_id": "bigint", "followers": "double"})
    u = filters.drop_unnamed(u)
    u = dedupe.dedupe_last(u, ["user_id"], ["src_priority"])
    return union.sort_columns_by_name(u)


# ------------------------------------------------------------------ tokens / training
def q_tokens_lexicon(spark, sf):
    d = with_words(_text(spark, sf, "documents", "doc_id", "text"))
    return d.select("doc_id", "words", F.size("words_arr").cast("bigint").alias("n_words"))


def q_training_lines(spark, sf):
    d = with_words(labelled_docs(spark, sf))
    return d.select("doc_id", "label", filters.label_line(F.col("label"), F.col("words")).alias("line"))


def q_training_corpus(spark, sf):
    d = with_words(labelled_docs(spark, sf))
    path = scratch_path(spark, "corpus")
    writers.write_training_text(writers.training_lines(d, "label", "words"), path)
    back = spark.read.text(path)
    return back.select(F.col("label").cast("string").alias("label"), F.col("value").alias("line"))


def q_vocabulary(spark, sf):
    d = with_words(_text(spark, sf, "documents", "doc_id", "text"))
    return aggregate.vocabulary(d, "words_arr")


def _vocab_docs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Words of all documents that occur at least 10 times in them (A12), and these words."""
    with shuffles_removed(spark):
        d = materialize(with_words(_text(spark, sf, "documents", "doc_id", "text")).select("doc_id", "words_arr"), "words")
        vocab = materialize(aggregate.vocabulary(d, "words_arr"), "vocab")
    return linear.restrict_to_vocabulary(d, "doc_id", "words_arr", vocab), vocab


def _all_grams(w):
    return F.concat(w, *[_ngrams(w, n) for n in range(2, linear.WORD_NGRAMS + 1)])


def q_ngram_counts(spark, sf):
    """The word 1- to 3-grams that the linear model hashes, over vocabulary words."""
    docs, vocab = _vocab_docs(spark, sf)
    return grams.count_grams(docs, "vocab_words", vocab, linear.VOCAB_BYTES, linear.WORD_NGRAMS)


def q_lr_features(spark, sf):
    """M3 inputs per post: number of n-grams and of distinct ones."""
    g = _all_grams(F.col("vocab_words"))
    return _vocab_docs(spark, sf)[0].select("doc_id", F.size(g).cast("bigint").alias("n_grams"), F.size(F.array_distinct(g)).cast("bigint").alias("n_distinct"))


def _ngrams(w, n: int):
    """Word n-grams of an array column (space-joined), empty when shorter than n."""
    idx = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.array_join(F.slice(w, i + 1, n), " "))


def q_weak_training_lines(spark, sf, cap: int = TRAINING_CAP):
    """M2 end to end (E1): keyword search per category (J1), capped per keyword newest
    first (L1/L4), one post per user and keyword (A10, newest kept), then cleaned,
    tokenised and written as ``__label__<category>, words`` lines (S11)."""
    d = _text(spark, sf, "documents", "doc_id", "source", "text")
    m = joins.keyword_label(d, DATA_KEYWORDS).select("category", "keyword", "doc_id", "source")
    m = dedupe.cap_per_key(m, ["category", "keyword"], dedupe.newest_first("doc_id"), cap)
    m = dedupe.dedupe_last(m, ["category", "keyword", "source"], ["doc_id"])
    # the texts meet the chosen ids only here, dealt by id for the cleaning
    chosen = d.select("doc_id", "text").join(m, "doc_id")
    w = with_words(chosen)
    return w.select("category", "keyword", "doc_id", filters.label_line(F.col("category"), F.col("words")).alias("line"))


def q_row_counts(spark, sf):
    d = with_words(labelled_docs(spark, sf))
    return aggregate.row_counts(writers.training_lines(d, "label", "words"), ["label"])


# ------------------------------------------------------------------ models
def q_nb_predict(spark, sf):
    return nb_scored(spark, sf).select("doc_id", "prediction", "score")


def q_nb_topk(spark, sf):
    return naive_bayes.top_k(nb_scored(spark, sf), "doc_id", k=3)


def q_nb_reload_predict(spark, sf):
    """M5 by a model that was fitted, saved and read again."""
    return nb_scored(spark, sf, fresh=True).select("doc_id", "prediction", "score")


def q_nb_repeated_ids(spark, sf):
    """Scoring knows rows, not ids: most ids repeat, and some are NULL."""
    d = _text(spark, sf, "documents", "doc_id", "text")
    d = d.select(F.when(F.col("doc_id") % 50 != 7, F.col("doc_id") % 50).alias("doc_id"), "text")
    s = naive_bayes.score_nb(nb_model(spark, sf), with_words(d), "doc_id", "words_arr", "words")
    return s.select(F.col("doc_id").alias("id"), "prediction", "score")


def q_tokens_lexicon_join(spark, sf):
    """J6 by a lexicon table, over rows whose ids repeat or are NULL."""
    lex = spark.createDataFrame([(k, p, b) for k, (p, b) in DEFAULT_LEXICON.items()], "surface string, pos string, base string")
    d = _text(spark, sf, "documents", "doc_id", "text")
    d = d.select(F.when(F.col("doc_id") % 50 != 7, F.col("doc_id") % 50).alias("id"), tokenize(clean_text("text")).alias("tokens"))
    return lexicon_join(d, "tokens", lex).select("id", join_tokens("words").alias("words"))


def _lr_fit(spark, sf, train: DataFrame):
    """M3: training words written once; the vocabulary (A12, >= 10 occurrences in the training
    corpus) restricts training and scored posts alike before the n-grams, as the reference's
    trainer and predictor drop rare / unknown words.  The model is saved and read again."""
    words, path = scratch_path(spark, "lr-train"), scratch_path(spark, "ngram-model")
    with shuffles_removed(spark):
        train.select("doc_id", "label", "words_arr").write.parquet(words)
        train = spark.read.parquet(words)
        vocab = materialize(aggregate.vocabulary(train, "words_arr"), "lr-vocab")
        free_shuffles(spark)
        # the n-grams are written: the words are restricted on the way to them
        train_v = linear.restrict_to_vocabulary(train, "doc_id", "words_arr", vocab, carry=("label",))
        ngram_model.save_ngram(ngram_model.fit_ngram(train_v, "vocab_words", "label"), path)
    remove_scratch(spark, words)
    return ngram_model.load_ngram(spark, path), vocab


def _lr_scored(model, vocab, docs: DataFrame, keys) -> DataFrame:
    # the length of the joined words is all that scoring needs of them: texts stay out of the keys
    docs = docs.select(*keys, F.length("words").alias("words_len"), "words_arr")
    docs_v = linear.restrict_to_vocabulary(docs, keys[0], "words_arr", vocab, carry=(*keys[1:], "words_len"))
    return ngram_model.score_ngram(model, docs_v, keys, "vocab_words", length_col="words_len")


def q_lr_predict(spark, sf):
    """M3 + M5: top label with its probability for all documents."""
    model, vocab = _lr_fit(spark, sf, with_words(labelled_docs(spark, sf)))
    out = _lr_scored(model, vocab, with_words(_text(spark, sf, "documents", "doc_id", "text")), ["doc_id"])
    return out.select("doc_id", "prediction", F.col("ranked")[0]["probability"].alias("probability"))


def q_lr_holdout(spark, sf):
    """M3 on a fixed split (a fifth of the labelled documents is held out): rows scored,
    classes among the answers' candidates, and whether it does at least as well as the
    larger class."""
    lab = with_words(labelled_docs(spark, sf))
    model, vocab = _lr_fit(spark, sf, lab.filter(F.col("doc_id") % 5 != 0))
    out = _lr_scored(model, vocab, lab.filter(F.col("doc_id") % 5 == 0), ["doc_id", "label"])
    right = F.avg((F.col("prediction") == F.concat(F.lit(filters.LABEL_PREFIX), F.col("label"))).cast("double"))
    share = F.avg((F.col("label") == TARGET_CLASS).cast("double"))
    return out.agg(F.count(F.lit(1)).alias("n_scored"), F.max(F.size("ranked")).cast("bigint").alias("n_classes"),
                   (right >= F.greatest(share, 1 - share)).alias("beats_majority"))


def q_class_split(spark, sf):
    s = nb_scored(spark, sf, carry=("source",))
    s = filters.class_split(s, TARGET_CLASS)
    return s.select("doc_id", "source", "prediction", "split",
                    filters.is_measurable(F.col("prediction")).alias("measurable"))


def _shares(spark, sf):
    s = nb_scored(spark, sf, carry=("source",))
    return aggregate.target_share(s, "source", TARGET_CLASS, id_col="doc_id")


def q_class_share(spark, sf):
    return _shares(spark, sf).select(F.col("source").alias("screen_name"), "n_target", "n_measurable", "share")


def q_share_stats(spark, sf):
    # one row per user, read by several passes (count, quantile band, stats): written once
    return aggregate.share_stats(materialize(_shares(spark, sf), "shares"))


def q_stats_by_source(spark, sf):
    """A5-A7 / M7 per group: every source's documents, and all events by type with their ties."""
    docs = aggregate.stats_by_key(_t(spark, sf, "documents"), "source", "n_chars").withColumnRenamed("source", "name")
    events = aggregate.stats_by_key(_t(spark, sf, "events").withColumn("tied", F.floor("value")), "event_type", "tied").withColumnRenamed("event_type", "name")
    both = docs.unionByName(events)
    return both.select("name", "n", F.round("mean", 6).alias("mean"), "median", F.round("stddev", 6).alias("stddev"))


def _user():
    """Stand-in for a post's author: a source and a span of ``USER_SPAN`` documents."""
    return F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / USER_SPAN).cast("string"))


def segmented(spark, sf) -> DataFrame:
    """E3 from the list to the segments: users found by a search (P8), their posts
    capped newest first (L1, L4), the activity floor (A2, J7), scores (M5), the share of the
    target class (A3), the newest post's attributes (A4) and the segment (M6)."""
    d = _t(spark, sf, "documents").withColumn("user", _user())
    # words of all documents, written once for the fit and the scores
    words = with_words(_text(spark, sf, "documents", "doc_id", "n_chars", "lang", "text"))
    words = materialize(words.select("doc_id", "n_chars", F.col("lang").alias("label"), F.length("words").alias("words_len"), "words_arr"), "segment-words")
    listed = filters.search_predicate(d, faves_col="n_chars", **SEARCH).select("user").distinct()
    posts = joins.user_timeline(d.select("user", "doc_id"), listed, "user")
    posts = materialize(dedupe.cap_per_key(posts, ["user"], dedupe.newest_first("doc_id"), TIMELINE_CAP), "timelines")
    active = joins.keep_keys(posts, aggregate.active_keys(posts, "user", "doc_id"), "user")
    model = naive_bayes.fit_nb(words, "label", "words_arr")
    # scored before they meet their users: words are not shuffled
    s = naive_bayes.score_nb(model, words.drop("label"), "doc_id", "words_arr", carry=("n_chars",), length_col="words_len").join(active, "doc_id")
    out = segment.segment_users(s, "user", ["doc_id"], ["doc_id", "n_chars"], LANG_TARGET, followers_col="n_chars", id_col="doc_id")
    return out.select(F.col("user").alias("screen_name"), F.col("doc_id").alias("newest_tweet_id"),
                      F.col("n_chars").alias("followers"), "n_target", "n_measurable", "n_posts", "target_share", "segment")


def q_segment_users(spark, sf):
    return segmented(spark, sf)


def q_segment_counts(spark, sf):
    return segment.segment_counts(spark, segmented(spark, sf))


# ------------------------------------------------------------------ sinks
def q_csv_round_trip(spark, sf):
    """S6-S9, S13 with texts and keys that a CSV file can lose: the word NA, the empty string,
    white space at the ends, keys with signs that paths escape."""
    kind = F.col("doc_id") % 10
    text = (F.when(kind == 1, "NA").when(kind == 2, "").when(kind == 3, F.concat(F.lit("  "), "text", F.lit(" \t"))).otherwise(F.col("text")))
    key = F.when(kind == 4, F.concat("source", F.lit(" a+b=50%/c"))).when(kind != 5, F.col("source"))
    d = _t(spark, sf, "documents").select("doc_id", key.alias("source"), text.alias("text"), "n_chars")
    path = scratch_path(spark, "csv")
    csv_files.write_csv(d, path, partition_by="source")
    schema = "doc_id BIGINT, text STRING, n_chars BIGINT, source STRING"
    back = csv_files.read_csv(spark, path, schema=spark.createDataFrame([], schema).schema, glob="*.csv", line_sep=None)
    return back.select("doc_id", "source", "text", "n_chars")


def q_partitioned_sinks(spark, sf):
    seg = materialize(segmented(spark, sf), "segmented")   # one row per user, written twice below
    path = scratch_path(spark, "segments")
    writers.write_segments(seg, path)
    writers.write_segments(seg, path)   # rerun: overwrite keeps the counts unchanged
    back = spark.read.schema(seg.schema).parquet(path)
    return back.groupBy("segment").agg(F.count(F.lit(1)).alias("n_users"))


def q_batched_sinks(spark, sf):
    """S10 + S15 + A8: the segmented users appended in three batches; the first is written
    twice, the second first with all rows.  Counts of the table and those observed."""
    seg = materialize(segmented(spark, sf), "segmented")
    part = F.pmod(F.xxhash64("screen_name"), F.lit(3))
    path = scratch_path(spark, "batches")
    batches.write_batch(seg.filter(part == 0), path, 0)
    batches.write_batch(seg, path, 1)
    observed = [batches.write_batch(seg.filter(part == b), path, b) for b in range(3)]
    sums = F.create_map(*[x for s in segment.SEGMENTS for x in (F.lit(s), F.lit(sum(o[s] for o in observed)).cast("bigint"))])
    counts = segment.segment_counts(spark, batches.read_batches(spark, path, seg.schema))
    return counts.select("segment", "n_users", sums[F.col("segment")].alias("n_observed"))


def q_scrape_posts(spark, sf):
    """The seven scraped lists (S5) with P9: search pages built from conversations, one post
    per turn; every third page has a post without a permalink.  The first post per user in
    output order stays, if it has at least ``MIN_FAVES`` likes."""
    c = _t(spark, sf, "conversations").withColumn("n", F.col("conv_id") * 100 + F.col("turn"))
    bare = (F.col("conv_id") % 3 == 0) & (F.col("turn") == 1)
    minute = F.to_timestamp_ntz(F.lit("2019-03-07 00:00:00")) + F.make_interval(mins=(F.col("n") % 1000).cast("int"))
    link = F.format_string('<a class="tweet-timestamp js-permalink" title="%s" href="/%s%s/status/%s">t</a>',
                           parse.scrape_time_text(minute), "role", "turn", "n")
    post = F.concat(
        F.lit('<li class="js-stream-item stream-item"><div data-name="User '), "role", F.lit('" class="tweet js-stream-tweet" data-conversation-id="'), "n",
        F.lit('">\n<a href="/x" class="account-group js-account-group" data-user-id="'), F.col("n") % 37, F.lit('">u</a>'),
        F.when(bare, "").otherwise(link), F.lit('<p class="js-tweet-text TweetTextSize" lang="ja">'), "text",
        F.lit('<b>\nRT</b></p><div class="ProfileTweet-actionCountList"><span id="profile-tweet-action-favorite-count-aria-'), "n", F.lit('">'),
        F.format_number(F.length("text") * 3 % 2000, 0), F.lit(parse.LIKE_SUFFIX), F.lit("</span></div></div></li>"))
    pages = (c.groupBy(F.col("conv_id").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("turn", post.alias("h")))).alias("p"))
             .select("page_id", F.concat(F.lit("<ol>"), F.array_join(F.transform("p", lambda x: x["h"]), "\n"), F.lit("</ol>")).alias("html")))
    posts = html.page_posts(pages)
    first = dedupe.dedupe_then_filter(posts, ["user_id"], ["page_id", "seq"], F.col("favorites") >= MIN_FAVES)
    return first.select("page_id", "seq", "aligned", "user_id", "screen_name", "user_name", "favorites", "created_at", "text", "tweet_id")


def landed_pages(spark, sf) -> str:
    """Search pages of 20 posts landed as JSON lines; a page repeats the first five posts of
    the next one, as pages do that are fetched while posts arrive."""
    raw = event_posts_raw(spark, sf)
    post = F.regexp_extract("page", r"(?s)^\{\"statuses\":\[(.*)\]\}$", 1)
    own = F.floor(F.col("event_id") / 20)
    pages = F.when(F.col("event_id") % 20 < 5, F.array(own, own - 1)).otherwise(F.array(own))
    e = raw.select(F.explode(pages).alias("p"), "event_id", post.alias("post"))
    text = F.concat(F.lit('{"statuses":['), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "post"))), lambda x: x["post"]), ","), F.lit("]}"))
    path = scratch_path(spark, "stream-land")
    e.groupBy("p").agg(text.alias("value")).select("value").write.text(path)
    return path


def q_stream_ingest(spark, sf):
    """Landed pages streamed in, retweets dropped, repeated ids kept once."""
    land = landed_pages(spark, sf)
    out = ingest.ingest_pages(spark, land)
    remove_scratch(spark, land)
    return out.select(F.col("tweet_id").alias("event_id"), "user_id", "favorites", "created_at_raw")


def q_scrape_nested(spark, sf):
    """Scraped pages (S5) built from conversations whose posts hold plain lists, comments and
    scripts with misleading tags, and, every third turn, a quoted post."""
    c = _t(spark, sf, "conversations").withColumn("n", F.col("conv_id") * 100 + F.col("turn"))

    def post(user, n, text, inside):
        return F.concat(F.lit('<li class="js-stream-item"><div class="js-stream-tweet" data-name="x" data-conversation-id="'), n,
                        F.lit('"><img src="a>b"><a class="js-account-group" data-user-id="'), user, F.lit('">u</a><p class="TweetTextSize">'),
                        text, F.lit("</p>"), inside, F.lit("</div></li>"))

    noise = F.lit('<!-- </li><li class="js-stream-item"> --><ul><li>one<li>two</li></ul><script>"</div></li>"</script><br/>')
    quoted = F.concat(F.lit("<ol>"), post(F.col("n") % 11, F.col("n") + 1000000000, F.col("role"), noise), F.lit("</ol>"))
    own = post(F.col("n") % 37, F.col("n"), F.col("text"), F.concat(noise, F.when(F.col("turn") % 3 == 1, quoted).otherwise("")))
    pages = (c.groupBy(F.col("conv_id").alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("turn", own.alias("h")))).alias("p"))
             .select("page_id", F.concat(F.lit("<ol>"), F.array_join(F.transform("p", lambda x: x["h"]), "\n"), F.lit("</ol>")).alias("html")))
    return html.page_posts_nested(pages).select("page_id", "pos", "seq", "parent", "user_id", "tweet_id", "text")


PAGE_POSTS = 5       # posts of a page of `landed_searches`
SEARCH_TOTAL = 12    # posts that a search takes there


def landed_searches(spark, sf) -> DataFrame:
    """Pages (search, seq, page) of one search per user over `events`, newest first.  A page
    begins with the last two posts of the page before; every fifth search has an empty
    page in the place of its third one, with pages behind it."""
    raw = event_posts_raw(spark, sf).select("event_id", F.regexp_extract("page", r"(?s)^\{\"statuses\":\[(.*)\]\}$", 1).alias("post"))
    e = _t(spark, sf, "events").select("event_id", F.col("user_id").alias("search")).join(raw, "event_id")
    at = F.row_number().over(Window.partitionBy("search").orderBy(F.desc("event_id"))) - 1
    e = e.withColumn("at", at).withColumn("own", F.floor(F.col("at") / PAGE_POSTS))
    on = F.when(F.col("at") % PAGE_POSTS >= PAGE_POSTS - 2, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))
    e = e.select("search", F.explode(on).alias("p"), "at", "post")
    posts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "post"))), lambda x: x["post"]), ",")
    pages = e.groupBy("search", "p").agg(posts.alias("posts"))
    empty = (F.col("search") % 5 == 0) & (F.col("p") >= 2)
    pages = pages.select("search", F.explode(F.when(empty & (F.col("p") == 2), F.array(F.struct(F.lit(2).cast("bigint").alias("seq"), F.lit("").alias("posts")),
                                                                                         F.struct(F.lit(3).cast("bigint").alias("seq"), F.col("posts"))))
                                             .otherwise(F.array(F.struct((F.col("p") + F.when(empty, 1).otherwise(0)).cast("bigint").alias("seq"), F.col("posts"))))).alias("r"))
    return pages.select("search", "r.seq", F.concat(F.lit('{"statuses":['), "r.posts", F.lit("]}")).alias("page"))


def _taken(rows):
    p = json_posts.flatten_posts(rows, "raw", keep=("search", "nth"))
    return p.select("search", "nth", F.col("tweet_id").alias("event_id"), "favorites", "created_at_raw")


def q_search_cursor_stream(spark, sf):
    """S16 + W2: the pages land in two parts that interleave; the stream is stopped between
    them and goes on from its checkpoint."""
    pages = materialize(landed_searches(spark, sf), "searches")
    land, out, ck = (scratch_path(spark, n) for n in ("search-land", "search-out", "search-ckpt"))
    late = F.col("seq") % 3 == 1
    for part in (pages.filter(~late), pages.filter(late)):
        part.write.mode("append").parquet(land)
        rows = ingest.follow_searches(spark, land, "search long, seq long, page string", out, ck, SEARCH_TOTAL)
    remove_scratch(spark, land)
    remove_scratch(spark, ck)
    return _taken(rows)


def q_search_cursor_batch(spark, sf):
    """The same over the table of pages."""
    return _taken(cursor.cursor_batch(landed_searches(spark, sf), SEARCH_TOTAL))


QUERIES = {
    "clean_documents": q_clean_documents,
    "clean_pages": q_clean_pages,
    "scrape_clean": q_scrape_clean,
    "html_links": q_html_links,
    "parse_created_at": q_parse_created_at,
    "parse_jp_time": q_parse_jp_time,
    "parse_counts": q_parse_counts,
    "flatten_json": q_flatten_json,
    "drop_retweets": q_drop_retweets,
    "only_text": q_only_text,
    "exclude_replies": q_exclude_replies,
    "list_members": q_list_members,
    "search_predicate": q_search_predicate,
    "keyword_label": q_keyword_label,
    "keyword_table_label": q_keyword_table_label,
    "lattice_words": q_lattice_words,
    "user_timeline": q_user_timeline,
    "retweeter_edges": q_retweeter_edges,
    "retweeters_json": q_retweeters_json,
    "unresolved_users": q_unresolved_users,
    "dedupe_first": q_dedupe_first,
    "dedupe_first_two_keys": q_dedupe_first_two_keys,
    "dedupe_last": q_dedupe_last,
    "dedupe_then_min_faves": q_dedupe_then_min_faves,
    "cap_per_query": q_cap_per_query,
    "cap_per_search": q_cap_per_search,
    "search_since": q_search_since,
    "scrape_posts": q_scrape_posts,
    "scrape_nested": q_scrape_nested,
    "lr_features": q_lr_features,
    "lr_holdout": q_lr_holdout,
    "nb_reload_predict": q_nb_reload_predict,
    "nb_repeated_ids": q_nb_repeated_ids,
    "tokens_lexicon_join": q_tokens_lexicon_join,
    "rotate_order": q_rotate_order,
    "union_sources": q_union_sources,
    "activity_floor": q_activity_floor,
    "tokens_lexicon": q_tokens_lexicon,
    "training_lines": q_training_lines,
    "weak_training_lines": q_weak_training_lines,
    "training_corpus": q_training_corpus,
    "vocabulary": q_vocabulary,
    "ngram_counts": q_ngram_counts,
    "nb_predict": q_nb_predict,
    "nb_topk": q_nb_topk,
    "lr_predict": q_lr_predict,
    "class_split": q_class_split,
    "class_share": q_class_share,
    "share_stats": q_share_stats,
    "stats_by_source": q_stats_by_source,
    "segment_users": q_segment_users,
    "segment_counts": q_segment_counts,
    "nfkc_documents": q_nfkc_documents,
    "tidy_output": q_tidy_output,
    "timeline_json": q_timeline_json,
    "csv_round_trip": q_csv_round_trip,
    "partitioned_sinks": q_partitioned_sinks,
    "batched_sinks": q_batched_sinks,
    "row_counts": q_row_counts,
    "stream_ingest": q_stream_ingest,
    "search_cursor_stream": q_search_cursor_stream,
    "search_cursor_batch": q_search_cursor_batch,
}
