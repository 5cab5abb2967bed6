"""Benchmark decontamination on a distributed positional inverted index (DataFrame operations only).

Words are runs of ASCII letters and digits (A-Z lower-cased) and of any non-ASCII character. A test
item of at least ``n`` words has a window at every offset; a shorter one, but not an empty one, is a
window as a whole. ``build_index`` counts every test term in the whole training corpus, picks each window's two rarest
words of those that the corpus has, and stores the training postings (term, document, position) of the words picked in the
shared folder. The offset-adjusted lists of such a pair are intersected from the rarer word on: where one stands in place and
the other at most ``slop`` words from its place, the window may. ``matches`` compares those places with the
document's words: a phrase match has all words in place, a proximity match at least ``share`` of them at most ``slop``
words from their places. So both are exact, but for a proximity match whose window has lost one of its pair: a test
item of ``2 * n`` words or more has windows without a changed word, and for shorter items all pairs of the
``SHORT_LISTS`` rarest words are looked up, of which two are always there. ``decontaminate`` reduces the matches to a row
per document.

A document's row key is a 128-bit hash of id and text, so null ids, repeated ids and repeated rows are
all right: equal rows share a key and get the same result. A null or empty text has no words. A window
with a word the corpus lacks has no phrase match. A proximity match may hang over a text's ends; the words outside count
as missing. Null item ids hit words and count as one item whose id is the empty string. Empty tables give no matches.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmart.llm.common import ascii_lower, materialise, small

WINDOW_WORDS = 10
SHORT_LISTS = 4
SHARE = 0.8
SLOP = 2
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DOC = ["k1", "k2"]


def words(c: Column) -> Column:
    """Array of words of a text; empty for null."""
    a = F.split(ascii_lower(F.coalesce(c, F.lit(""))), _BREAKS)
    return F.array_remove(a, "")


def doc_keys(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    i, t = F.col(id_col), F.col(text_col)
    return docs.select(F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i, F.lit(1)).alias("k2"), *more)


@dataclass
class Index:
    """The written tables of one benchmark over one corpus."""
    windows: DataFrame    # wid, win (array), len, short
    items: DataFrame      # wid, item
    pairs: DataFrame      # wid, term, off, other, other_off: a pair of words, the rarer first
    postings: DataFrame   # term, k1, k2, pos, id; and a row per document with a null term, whose pos is its number of words
    longest: int          # words of the longest window


def test_windows(bench: DataFrame, item_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, win, len, short: of an item of fewer than ``2 * n`` words) and their items (wid, item)."""
    w = F.col("w")
    each = bench.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size(w) > 0).select(
        "item", (F.size(w) < 2 * n).alias("short"), F.explode(F.when(F.size(w) < n, F.array(w)).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.slice(w, i + 1, n)))).alias("win"))
    wins = materialise(each.groupBy("win").agg(F.max("short").alias("short")).select(
        F.monotonically_increasing_id().alias("wid"), "win", F.size("win").alias("len"), "short"), "windows")
    items = materialise(each.join(wins.drop("short"), "win").select("wid", "item").distinct(), "window-items")
    return wins, items


def doc_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, pos, term) for every word of every document."""
    return doc_keys(docs, id_col, text_col, F.posexplode(words(F.col(text_col))).alias("pos", "term"))


def build_index(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                item_text: str = "text", n: int = WINDOW_WORDS) -> Index:
    wins, items = test_windows(bench, item_col, item_text, n)
    entries = wins.select("wid", "short", F.posexplode("win").alias("off", "term"))
    terms = materialise(entries.select("term").distinct(), "terms")
    counts = materialise(doc_words(docs, id_col, text_col).join(small(terms), "term").groupBy("term").agg(
        F.count(F.lit(1)).alias("cf")), "term-counts")
    rank = F.row_number().over(Window.partitionBy("wid").orderBy("cf", "off"))
    of = F.count(F.lit(1)).over(Window.partitionBy("wid"))
    ranked = materialise(entries.join(counts, "term").select("wid", "short", "term", "off", rank.alias("r"), of.alias("n")).where(F.col("r") <= SHORT_LISTS), "ranked")
    # a window of which the corpus has one word only pairs it with itself
    a, b = ranked.alias("a"), ranked.alias("b")
    wanted = ((F.col("a.r") == 1) & (F.col("b.r") == F.least("a.n", F.lit(2)))) | (F.col("a.short") & (F.col("a.r") < F.col("b.r")))
    pairs = a.join(b, F.col("a.wid") == F.col("b.wid")).where(wanted).select(
        "a.wid", "a.term", "a.off", F.col("b.term").alias("other"), F.col("b.off").alias("other_off"))
    pairs = materialise(pairs, "pairs")
    used = materialise(pairs.select("term").unionAll(pairs.select("other")).distinct(), "used-terms")
    # one more place behind a document's last word tells its number of words, so that they need no pass of their own
    end = F.concat(words(F.col(text_col)), F.array(F.lit(None).cast("string")))
    all_places = doc_keys(docs, id_col, text_col, F.col(id_col).alias("id"), F.posexplode(end).alias("pos", "term"))
    posts = all_places.join(small(used.withColumn("used", F.lit(True))), "term", "left").where("used OR term IS NULL")
    posts = materialise(posts.select("term", *_DOC, "pos", "id"), "postings")
    return Index(wins, items, pairs, posts, wins.agg(F.max("len")).first()[0] or 0)


def candidates(ix: Index, slop: int = SLOP) -> DataFrame:
    """Places (k1, k2, wid, start) that a pair's lists allow: one word in place, the other at most ``slop`` words from its."""
    first = ix.postings.join(small(ix.pairs), "term").select(*_DOC, "wid", F.col("other").alias("term"), "other_off", (F.col("pos") - F.col("off")).alias("d"))
    both = first.join(ix.postings.drop("id"), ["term", *_DOC]).withColumn("e", F.col("pos") - F.col("other_off")).where(F.abs(F.col("e") - F.col("d")) <= slop)
    return both.select(*_DOC, "wid", F.explode(F.array("d", "e")).alias("start")).distinct()


def matches(docs: DataFrame, ix: Index, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, slop: int = SLOP) -> DataFrame:
    """Matches (k1, k2, wid, start, len, exact, in_place): the window's words stand at ``start`` of the document (exact), or
    ``in_place`` of them, at least ``share``, lie at most ``slop`` words from their places."""
    cand = materialise(candidates(ix, slop), "candidates")
    per_doc = materialise(cand.groupBy(*_DOC).agg(F.collect_list(F.struct("wid", "start")).alias("c")), "per-doc")
    have = doc_keys(docs, id_col, text_col, F.col(text_col).alias("t")).join(small(per_doc.select(*_DOC)), _DOC, "left_semi")
    texts = have.dropDuplicates(_DOC).select(*_DOC, words(F.col("t")).alias("w"))
    # the words round each place, before the places become rows; ``pad`` words are missing where it hangs over the text's start
    reach = ix.longest + 2 * slop
    parts = F.expr(f"""transform(c, x -> struct(x.wid AS wid, x.start AS start, greatest(0, {slop} - x.start) AS pad,
        slice(w, greatest(1, x.start - {slop - 1}), greatest(0, least(size(w), x.start - {slop} + {reach}) - greatest(0, x.start - {slop}))) AS part))""")
    here = texts.join(per_doc, _DOC).select(*_DOC, F.explode(parts).alias("p")).select(*_DOC, "p.*")
    read = here.join(small(ix.windows), "wid")
    # word i of the window is looked for among the 2 * slop + 1 words round its place
    found = F.expr(f"""size(filter(sequence(0, len - 1), i -> array_contains(
        slice(part, greatest(1, i - pad + 1), greatest(0, i - pad + {2 * slop + 1} - greatest(0, i - pad))), win[i])))""")
    exact = F.expr(f"slice(part, greatest(1, {slop} - pad + 1), len) = win AND pad <= {slop}")
    out = read.select(*_DOC, "wid", "start", "len", exact.alias("exact"), found.alias("in_place"))
    return out.where(F.col("exact") | (F.col("in_place") >= F.ceil(F.col("len") * share)))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", n: int = WINDOW_WORDS, share: float = SHARE, slop: int = SLOP) -> DataFrame:
    """One row (id, k1, k2, n_words, n_hit, n_items, items, n_near) per document row; ``items``: sorted id strings of the items
    with a phrase match; ``n_near``: items with a phrase or proximity match."""
    ix = build_index(docs, bench, id_col, text_col, item_col, item_text, n)
    every = materialise(matches(docs, ix, id_col, text_col, share, slop), "matches")
    hits = every.where("exact")
    before = Window.partitionBy(*_DOC).orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    cover = hits.select(*_DOC, "start", "len").distinct().select(
        *_DOC, F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))).alias("new"))
    n_hit = cover.groupBy(*_DOC).agg(F.sum("new").alias("n_hit"))
    names = (hits.select(*_DOC, "wid").distinct().join(small(ix.items), "wid").select(*_DOC, "item").distinct()
             .groupBy(*_DOC).agg(F.count(F.lit(1)).alias("n_items"),
                                 F.array_sort(F.collect_list(F.coalesce(F.col("item").cast("string"), F.lit("")))).alias("items")))
    near = (every.select(*_DOC, "wid").distinct().join(small(ix.items), "wid").select(*_DOC, "item").distinct()
            .groupBy(*_DOC).agg(F.count(F.lit(1)).alias("n_near")))
    base = ix.postings.where("term IS NULL").select("id", *_DOC, F.col("pos").cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    found = materialise(near.join(n_hit.join(names, _DOC), _DOC, "left"), "found")
    return base.join(small(found), _DOC, "left").select(
        "id", *_DOC, "n_words", F.coalesce("n_hit", zero).cast("long").alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", zero).alias("n_near"))
