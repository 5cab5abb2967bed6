"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only).

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share ``budget`` times
all words; no target exceeds ``repeats`` times its source's words, the excess going to the others by
weight until none is above (a source without words has target 0). Quotas: the mix is dealt in blocks
of ``block`` words. Blocks go to sources by highest quotients target / 1, 3, 5, ..., then each source's
blocks to its shards by highest quotients words / 1, 3, 5, ... A shard is a hash class of a source's
documents of about ``shard_words`` words (more where the corpus would have over ``MAX_SHARDS`` of them), so a source
that holds a third of all rows spreads over many.
Selection: a shard lays its documents end to end in seeded order (md5 of seed and id, then of the text)
and takes its quota of blocks from the start, wrapping round after the last word; the last block of
the last round is cut at ``repeats`` times the shard's words. A document is taken in part where the
last block ends inside it.

``plan`` works on narrow rows and leaves a row per shard: its full rounds, and the document at which the rest
ends. ``apply`` looks a document's shard up in that table, which has at most ``MAX_SHARDS`` rows and one a
source, so the documents themselves are not shuffled. Only rows equal to a cut document are numbered.

Reruns agree, as the order depends on seed, id and text only. Null texts have size 0 and are never
taken; rows with null or repeated ids take part like any other, and equal rows are interchangeable.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmart.llm.common import materialise, numbered, small

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEATS = 2
BLOCK = 8
SHARD_WORDS = 1_000_000
MAX_SHARDS = 50_000
SEED = 17


def n_words(c: Column) -> Column:
    """Number of runs ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    parts = F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+")
    empty = (parts[0] == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - empty).cast("long")


def first_words(c: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; empty if n is 0 or the text has fewer words."""
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+"))     # possessive: no recursion
    return F.when(n > 0, F.coalesce(F.regexp_substr(c, pattern), F.lit(""))).otherwise(F.lit(""))


def sainte_lague(parties: DataFrame, group: str, party: str, weight: str, house: str) -> DataFrame:
    """Add ``seats``: in each ``group``, ``house`` seats go to the highest quotients weight / 1, 3, 5, ...;
    equal quotients go by ``party``.

    A divisor that can only deal out too few seats (each party is off by half a seat at most) gives
    the first part at once, so at most as many seats as there are parties are left to rank.
    """
    w = Window.partitionBy(group)
    n, total = F.count(F.lit(1)).over(w), F.sum(weight).over(w)
    t = parties.select("*", n.alias("_n"), total.alias("_w"))
    left = F.col(house) - F.col("_n") / 2
    first = F.when((left > 0) & (F.col("_w") > 0), F.floor(F.col(weight) / F.col("_w") * left * F.lit(1 - 1e-12) + 0.5)).otherwise(F.lit(0))
    t = t.withColumn("_s", first.cast("long")).withColumn("_k", F.greatest(F.lit(0), F.col(house) - F.sum("_s").over(w)))
    share = F.when(F.col("_w") > 0, F.col(weight) / F.col("_w")).otherwise(F.lit(0.0))
    most = (F.ceil(share * (F.col("_k") + F.col("_n"))) + 1).cast("long")
    bids = t.where(F.col(weight) > 0).select(group, party, weight, "_s", "_k", F.explode(F.sequence(F.lit(1).cast("long"), most)).alias("_j"))
    quotient = F.col(weight) / (2 * (F.col("_s") + F.col("_j")) - 1)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(quotient.desc(), F.col(party).asc()))
    won = bids.select(group, party, "_k", rank.alias("_r")).where("_r <= _k").groupBy(group, party).agg(F.count(F.lit(1)).alias("_x"))
    return t.join(won, [group, party], "left").withColumn("seats", F.col("_s") + F.coalesce("_x", F.lit(0))).drop("_n", "_w", "_s", "_k", "_x")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: float = REPEATS) -> DataFrame:
    """From (source, source_size) to (rk, source, source_size, target); one row per source."""
    one = Window.partitionBy(F.lit(0))
    t = sizes.select("source", "source_size", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())).cast("int").alias("rk"))
    kinds = F.array(*[F.lit(float(x)) for x in weights])
    t = t.withColumn("w", F.element_at(kinds, (F.col("rk") - 1) % len(weights) + 1))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("ratio", F.col("cap") / F.col("w"))
    order = one.orderBy("ratio", "rk")
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    # the level at which what is left fills the sources still open: it rises up to the first source that
    # stays below its cap and falls behind it
    t = t.withColumn("level", (F.sum("source_size").over(one) * F.lit(float(budget)) - capped) / open_w)
    return t.select("rk", "source", "source_size", F.least("cap", F.max("level").over(one) * F.col("w")).alias("target"))


@dataclass
class Plan:
    """``sources``: (source, rk, source_size, target, n_shards); ``shards``: (rk, shard, rounds, cut, copies, before, part):
    documents ordered before ``cut`` are taken once more than ``rounds``, and of its ``copies`` equal rows ``before``
    are, and ``part`` words of the next. Both are written tables."""
    sources: DataFrame
    shards: DataFrame
    seed: int


def _place(id_col: str, text_col: str, seed: int) -> Column:
    """A document's place in the seeded order of its shard."""
    i = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), i)), F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _shard(place: Column, n_shards: Column) -> Column:
    return F.conv(F.substring(place, 1, 8), 16, 10).cast("long") % n_shards


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, block: int = BLOCK,
         shard_words: int = SHARD_WORDS, seed: int = SEED) -> Plan:
    """What the mix takes of each shard."""
    rows = materialise(docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                                   _place(id_col, text_col, seed).alias("place")), "mix-rows")
    per_source = materialise(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, repeats), "targets")
    one = Window.partitionBy(F.lit(0))
    house = F.floor(F.sum("target").over(one) / block + 0.5)
    dealt = sainte_lague(per_source.select("*", F.lit(0).alias("g"), house.alias("house")), "g", "rk", "target", "house").drop("g", "house")
    width = F.greatest(F.lit(shard_words), F.ceil(F.sum("source_size").over(one) / MAX_SHARDS))
    sources = materialise(dealt.select("*", F.greatest(F.lit(1), F.ceil(F.col("source_size") / width)).cast("long").alias("n_shards")), "quotas")
    placed = rows.alias("r").join(small(sources).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "size", "place", "rk", "seats", _shard(F.col("place"), F.col("n_shards")).alias("shard"))
    sums = placed.groupBy("rk", "shard").agg(F.sum("size").alias("shard_size"), F.max("seats").alias("house"))
    quota = materialise(sainte_lague(sums, "rk", "shard", "shard_size", "house").select("rk", "shard", "shard_size", "seats"), "seats")
    total = F.least(F.col("seats") * block, F.col("shard_size") * repeats)
    rounds = F.when(F.col("shard_size") > 0, F.floor(total / F.col("shard_size"))).otherwise(F.lit(0))
    quota = quota.withColumn("rounds", rounds.cast("long")).withColumn("rest", total - F.col("rounds") * F.col("shard_size"))
    w = Window.partitionBy("rk", "shard").orderBy("place")
    laid = placed.drop("seats").select(
        "*", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        (F.row_number().over(w) - F.rank().over(w)).cast("long").alias("before"), F.count(F.lit(1)).over(Window.partitionBy("rk", "shard", "place")).alias("copies"))
    rest = F.col("rest")
    cut = laid.join(quota.select("rk", "shard", "rest"), ["rk", "shard"]).where((F.col("start") < rest) & (rest <= F.col("start") + F.col("size"))).select(
        "rk", "shard", F.col("place").alias("cut"), "copies", "before", (rest - F.col("start")).cast("long").alias("part"))
    shards = quota.join(cut, ["rk", "shard"], "left").select("rk", "shard", "rounds", "cut", "copies", "before", "part")
    return Plan(sources.select("source", "rk", "source_size", "target", "n_shards"), materialise(shards, "shards"), seed)


def apply(docs: DataFrame, p: Plan, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          names: Sequence[str] = ("size", "source_size", "target", "taken")) -> DataFrame:
    """``docs`` with the four columns ``names``, which it must not have: its words, its source's, the source's target, the
    words that the mix takes of it."""
    t = "_mix"
    while any(c.startswith(t) for c in docs.columns):
        t += "_"
    sources = p.sources.select(*[F.col(c).alias(f"{t}_{c}") for c in p.sources.columns])
    shards = p.shards.select(F.col("rk").alias(f"{t}_k"), F.col("shard").alias(f"{t}_s"), *[F.col(c).alias(f"{t}_{c}") for c in p.shards.columns[2:]])
    # one row a source, and at most MAX_SHARDS more: held against the bytes, not the usual number of rows
    sources, shards = (small(d, 4 * MAX_SHARDS) for d in (sources, shards))

    def c(name: str) -> Column:
        return F.col(f"{t}_{name}")

    d = docs.withColumns({f"{t}_size": n_words(F.col(text_col)), f"{t}_place": _place(id_col, text_col, p.seed)})
    d = d.join(sources, F.col(source_col).eqNullSafe(c("source"))).withColumn(f"{t}_shard", _shard(c("place"), c("n_shards")))
    d = d.join(shards, (c("rk") == c("k")) & (c("shard") == c("s")))
    at_cut = F.coalesce(c("place") == c("cut"), F.lit(False))
    once_more = F.when(c("place") < c("cut"), c("size")).when(at_cut, c("part")).otherwise(F.lit(0))

    def done(rows: DataFrame, more: Column) -> DataFrame:
        return rows.select(*docs.columns, *[x.alias(n) for x, n in zip(
            (c("size"), c("source_size"), c("target"), (c("rounds") * c("size") + more).cast("long")), names)])

    if p.shards.where("copies > 1").isEmpty():
        return done(d, once_more)
    equal = at_cut & (c("copies") > 1)
    some = numbered(d.where(equal), [f"{t}_rk", f"{t}_shard"], f"{t}_no")
    i = c("no")
    return done(d.where(~equal), once_more).unionByName(done(some, F.when(i < c("before"), c("size")).when(i == c("before"), c("part")).otherwise(F.lit(0))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """One row (id, size, source, source_size, target, taken) per document row."""
    p = plan(docs, id_col, text_col, source_col, **parameters)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return apply(rows, p, "id", "text", "source").drop("text")
