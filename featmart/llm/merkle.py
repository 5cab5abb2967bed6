"""Merkle manifest of a table: levels stored as parent-linked node rows, proofs by a recursive climb.

A leaf is the SHA-256 of a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.
Per source the leaves ascend by id; every ``FANOUT`` consecutive nodes (the last run fewer, even one) become
the SHA-256 of their hex digests, until one remains: the subroot. Subroots ordered by source (null first,
by UTF-8 bytes) are joined likewise to the root.

Numbering: the narrow leaf rows are range-partitioned by source and id; a row's number is its place in its
partition plus the counts of the partitions before, so a source that holds a third of all rows spreads over
many tasks. Levels are built bottom up, each a group-by of at most ``FANOUT`` rows a group, and written.

Climb: a recursive query ascends from the leaves to the root by the parent links. The leaves below one node
of level 2 have the same ancestors, so such a pack of at most ``FANOUT`` squared leaves ascends in one row with
a fold for each different leaf hash: every step appends the siblings at that node and folds each hash with them.
Inside a pack all siblings are at hand, so its first steps are done where it is made. As all packs meet in the
upper nodes, a node has a copy for every ``SHARE`` packs below it, and a pack asks for one copy by its hash: no
join key is hot.

Odd rows: a null id sorts first and is never tampered with; rows with the same id ascend by leaf digest, equal
rows are interchangeable; an empty table has no leaves and gives no rows. Columns not named are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmart.llm.common import ascii_lower, materialise

FANOUT = 16
SHARE = 256
TAMPER_EVERY = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64
_TOP = -1           # the tree of subroots
_RUN_DIGESTS = "array_join(transform(runs, k -> sha2(k, 256)), '')"
_UNLIMITED = {"spark.sql.cteRecursionRowLimit": "-1"}


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 over the fields, each marked null or preceded by its length in bytes."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*map(part, fields)), 256)


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
           text_col: str = "text", every: int = TAMPER_EVERY) -> DataFrame:
    """(id, source, leaf, tampered): ``tampered`` is the leaf with the text's A-Z lower-cased where ``every``
    divides the id's CRC-32, else null."""
    chosen = F.crc32(F.col(id_col).cast("string")) % every == 0
    changed = leaf_digest([ascii_lower(F.col(c)) if c == text_col else F.col(c) for c in fields])
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       leaf_digest([F.col(c) for c in fields]).alias("leaf"), F.when(chosen, changed).alias("tampered"))


def _sorted(df: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in order, written, with its range partition ``_p`` and a running number ``_m``; and per group and
    partition the ``_shift`` that makes ``_m`` the row's place in its group, from 0, with the group's count ``n``."""
    t = materialise(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
                    .withColumn("_m", F.monotonically_increasing_id()), name).withColumn("_p", F.shiftright("_m", 33))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("c").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = t.groupBy(*group, "_p").agg(F.min("_m").alias("m"), F.count(F.lit(1)).alias("c"))
    return t, materialise(spans.select(*group, "_p", (before - F.col("m")).alias("_shift"), F.sum("c").over(w).alias("n")), f"{name}-spans")


@dataclass
class Manifest:
    """``packs``: (tree, pack, n, members, runs, digest), the leaves by nodes of level 2, ``runs`` being the joined digests
    of each run; ``nodes``: (tree, level, pos, salt, kids, digest and the parent's p_tree, p_level, p_pos, p_slot, p_copies),
    every node above the packs; ``links``: a row per pack with its parent's. All are written tables."""
    packs: DataFrame
    nodes: DataFrame | None
    links: DataFrame
    fanout: int


def _parent(n_trees: int, fanout: int) -> list[Column]:
    """The parent's tree, level, position and the place among its children, of a node row (tree, level, pos, cnt)."""
    more, up = F.col("cnt") > 1, (F.col("tree") >= 0) & F.lit(n_trees > 1)
    at = F.when(more, F.col("pos")).when(up, F.col("tree"))
    return [F.when(more, F.col("tree")).when(up, F.lit(_TOP).cast("long")).alias("p_tree"),
            F.when(more, F.col("level") + 1).when(up, F.lit(1)).cast("int").alias("p_level"),
            F.floor(at / fanout).cast("long").alias("p_pos"), (at % fanout).cast("int").alias("p_slot")]


def _next_level(below: DataFrame, level: int, fanout: int) -> DataFrame:
    """Nodes over (tree, pos, cnt, digest, load): every ``fanout`` consecutive ones become one."""
    kids = F.array_sort(F.collect_list(F.struct("pos", "digest")))
    up = below.groupBy("tree", F.floor(F.col("pos") / fanout).cast("long").alias("up"), "cnt").agg(
        kids.alias("k"), F.sum("load").alias("load"))
    up = up.select("tree", F.lit(level).alias("level"), F.col("up").alias("pos"), F.ceil(F.col("cnt") / fanout).cast("long").alias("cnt"),
                   F.array_join(F.transform("k", lambda x: x["digest"]), "").alias("kids"), "load")
    return up.withColumn("digest", F.sha2("kids", 256))


def build(leaf_rows: DataFrame, fanout: int = FANOUT, share: int = SHARE) -> Manifest:
    """The manifest of ``leaves`` rows."""
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    rows = materialise(leaf_rows.withColumn("key", key), "leaves")          # texts are read and hashed once
    t, spans = _sorted(rows, ["key"], ["id", "leaf"], "leaf-order")
    trees, places = _sorted(spans.select("key", "n").distinct(), [], ["key"], "sources")
    trees = materialise(trees.join(places.withColumnRenamed("n", "n_trees"), "_p").select("key", (F.col("_m") + F.col("_shift")).alias("tree"), "n_trees"), "trees")
    head = trees.agg(F.max("n_trees")).first()[0]
    n_trees = head or 0
    numbered = t.join(spans.join(trees, "key"), ["key", "_p"]).withColumn("pos", F.col("_m") + F.col("_shift"))
    width = fanout * fanout
    members = F.array_sort(F.collect_list(F.struct((F.col("pos") % width).cast("int").alias("slot"), "id", "leaf", "tampered")))
    packs = numbered.groupBy("tree", F.floor(F.col("pos") / width).cast("long").alias("pack"), "n").agg(members.alias("members"))
    packs = packs.withColumn("runs", F.expr(f"""transform(sequence(0, (size(members) - 1) div {fanout}),
        r -> array_join(transform(slice(members, r * {fanout} + 1, {fanout}), m -> m.leaf), ''))"""))
    packs = materialise(packs.withColumn("digest", F.expr(f"""CASE WHEN n = 1 THEN runs[0] WHEN n <= {fanout} THEN sha2(runs[0], 256)
        ELSE sha2({_RUN_DIGESTS}, 256) END""")), "packs")
    # a tree of at most one run has no level 2: its top is the run's digest, or the lone leaf
    first = packs.select("tree", F.lit(2).alias("level"), F.col("pack").alias("pos"), F.ceil(F.col("n") / width).cast("long").alias("cnt"),
                         "digest", F.lit(1).cast("long").alias("load"))

    made: list[DataFrame] = []

    def raise_to_top(below: DataFrame, level: int) -> DataFrame:
        """Build and write levels until every tree has one node; the top nodes of all trees."""
        tops = below.where("cnt = 1").select("tree", "digest", "load")
        below = below.where("cnt > 1")
        most = below.agg(F.max("cnt")).first()[0] or 1                    # one number: how high the highest tree is
        while most > 1:
            made.append(materialise(_next_level(below, level, fanout), f"level-{level}"))
            tops = tops.unionByName(made[-1].where("cnt = 1").select("tree", "digest", "load"))
            below, level, most = made[-1].where("cnt > 1"), level + 1, -(-most // fanout)
        return tops

    tops = raise_to_top(first, 3)
    if n_trees > 1:
        raise_to_top(tops.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("pos"),
                                 F.lit(n_trees).cast("long").alias("cnt"), "digest", "load"), 1)
    # how many copies a node has follows from the runs below it; its children must know
    parent = ["p_tree", "p_level", "p_pos"]
    links, nodes = first.select("*", *_parent(n_trees, fanout)), None
    if made:
        every = made[0]
        for m in made[1:]:
            every = every.unionByName(m)
        every = materialise(every.withColumn("copies", F.ceil(F.col("load") / share).cast("long")), "levels")
        above = every.select(F.col("tree").alias("p_tree"), F.col("level").alias("p_level"), F.col("pos").alias("p_pos"), F.col("copies").alias("p_copies"))
        links = links.join(above, parent, "left")
        nodes = every.select("*", *_parent(n_trees, fanout)).join(above, parent, "left").withColumn(
            "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        nodes = materialise(nodes.select("tree", "level", "pos", "salt", "kids", "digest", *parent, "p_slot", "p_copies"), "nodes")
    else:
        links = links.withColumn("p_copies", F.lit(None).cast("long"))
    return Manifest(packs, nodes, materialise(links.select("tree", F.col("pos").alias("pack"), *parent, "p_slot", "p_copies"), "links"), fanout)


def _replaced(kids: str, slot: str, mine: str) -> str:
    """SQL: the SHA-256 of ``kids`` with ``mine`` in place of the digest at ``slot``."""
    return f"sha2(concat(substring({kids}, 1, {_HEX} * ({slot})), {mine}, substring({kids}, {_HEX} * ({slot}) + {_HEX + 1})), 256)"


def _others(kids: str, slot: str) -> str:
    return f"concat(substring({kids}, 1, {_HEX} * ({slot})), substring({kids}, {_HEX} * ({slot}) + {_HEX + 1}))"


def _folds(fanout: int) -> str:
    """SQL: what each member of a pack folds to at the pack's node."""
    mine = "coalesce(m.tampered, m.leaf)"
    run = _replaced(f"runs[m.slot div {fanout}]", f"m.slot % {fanout}", mine)
    return f"""transform(members, m -> CASE WHEN n = 1 THEN {mine} WHEN n <= {fanout} THEN {run}
        ELSE {_replaced(_RUN_DIGESTS, f"m.slot div {fanout}", run)} END)"""


def climb(m: Manifest) -> DataFrame:
    """(tree, pack, siblings, starts, folds, subroot, root) per pack: the digests beside its path from the pack up, and
    what each different hash that its leaves fold to at the pack's node (``starts``) folds to at the root (``folds``)."""
    spark, name = m.packs.sparkSession, f"merkle_{uuid.uuid4().hex}"
    start = m.packs.join(m.links, ["tree", "pack"]).withColumn("starts", F.array_distinct(F.expr(_folds(m.fanout)))).select(
        "tree", "pack", "p_tree", "p_level", "p_pos", "p_slot", F.expr("pmod(xxhash64(tree, pack), p_copies)").alias("salt"),
        F.lit("").alias("siblings"), "starts", F.col("starts").alias("folds"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    start = materialise(start, "climb-start")
    if m.nodes is None:
        return start.select("tree", "pack", "siblings", "starts", "folds", "subroot", "root")
    before = {k: spark.conf.get(k, None) for k in _UNLIMITED}
    views = {f"{name}_start": start.drop("starts"), f"{name}_nodes": m.nodes}
    for v, df in views.items():
        df.createOrReplaceTempView(v)
    try:
        for k, v in _UNLIMITED.items():          # rows are as many as packs times levels; levels are few
            spark.conf.set(k, v)
        top = materialise(spark.sql(f"""
            WITH RECURSIVE path(tree, pack, p_tree, p_level, p_pos, p_slot, salt, siblings, folds, subroot, root) AS (
              SELECT * FROM {name}_start
              UNION ALL
              SELECT c.tree, c.pack, n.p_tree, n.p_level, n.p_pos, n.p_slot, pmod(xxhash64(c.tree, c.pack), n.p_copies),
                     concat(c.siblings, {_others('n.kids', 'c.p_slot')}), transform(c.folds, f -> {_replaced('n.kids', 'c.p_slot', 'f')}),
                     CASE WHEN n.tree = c.tree THEN n.digest ELSE c.subroot END, n.digest
              FROM path c JOIN {name}_nodes n ON c.p_tree = n.tree AND c.p_level = n.level AND c.p_pos = n.pos AND c.salt = n.salt)
            SELECT tree, pack, siblings, folds, subroot, root FROM path WHERE p_tree IS NULL"""), "climbed")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for v in views:
            spark.catalog.dropTempView(v)
    return top.join(start.select("tree", "pack", "starts"), ["tree", "pack"])


def verify(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
           fanout: int = FANOUT, every: int = TAMPER_EVERY) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``."""
    m = build(leaves(docs, fields, id_col, source_col, text_col, every), fanout)
    d = m.packs.join(climb(m), ["tree", "pack"]).withColumn("both", F.explode(F.arrays_zip("members", F.expr(_folds(fanout)).alias("at"))))
    slot = "both.members.slot"
    run = f"CASE WHEN n = 1 THEN '' ELSE {_others(f'runs[{slot} div {fanout}]', f'{slot} % {fanout}')} END"
    pack = f"CASE WHEN n <= {fanout} THEN '' ELSE {_others(_RUN_DIGESTS, f'{slot} div {fanout}')} END"
    fold = F.expr("folds[array_position(starts, both.at) - 1]")
    return d.select(F.col("both.members.id").alias("id"), F.col("both.members.leaf").alias("leaf"), "subroot", "root",
                    F.sha2(F.concat(F.expr(run), F.expr(pack), "siblings"), 256).alias("proof_sha256"), fold.alias("folded_root"),
                    (fold == F.col("root")).alias("verified"))
