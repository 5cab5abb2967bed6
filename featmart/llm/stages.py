"""The stages of the corpus pipeline: each calls one operator and lets its decisions take effect.

Rows are matched to decisions by a 128-bit hash of id and text, so null and repeated ids are all right;
equal rows get equal decisions; in the mix equal rows may differ in what is taken of them, and only those are numbered.
Decisions are made on narrow rows and looked up by the documents (``common.marked``, ``mixing.apply``), so texts are
neither shuffled nor written a second time. Every column of the input is kept, whatever else it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmart.llm import decontam, langid, mixing, pii, simhash
from featmart.llm.common import marked, materialise

ID, TEXT = "doc_id", "text"


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two key columns of names that it does not have yet."""
    names = []
    while len(names) < 2:
        name = f"_row_key{len(names)}"
        while name in docs.columns:
            name += "_"
        names.append(name)
    i, t = F.col(ID), F.col(TEXT)
    return docs.withColumns({names[0]: F.xxhash64(i, t), names[1]: F.xxhash64(t, i, F.lit(1))}), names


def _marked(docs: DataFrame, inside: DataFrame, others: DataFrame) -> tuple[DataFrame, list[str], str]:
    """``docs`` with key columns and a flag: whether the key is in ``inside``; ``others`` has all other keys (k1, k2)."""
    keyed, names = _keyed(docs)
    flag = names[0] + "_in"
    inside, others = (d.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1])) for d in (inside, others))
    return marked(keyed, names, inside, others, flag), names, flag


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID, learned from the labelled rows outside the held-out quarter: rejected documents go."""
    model = langid.fit(docs.where(~langid.held_out(ID)), ID, TEXT)
    return langid.accepted(docs, model, TEXT)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of linked documents the one with the smallest id stays (null
    ids last, then by text hash); of rows equal in id and text one stays."""
    i, t = F.col(ID), F.col(TEXT)
    keys = (F.xxhash64(i, t).alias("k1"), F.xxhash64(t, i, F.lit(1)).alias("k2"))
    prints = materialise(simhash.fingerprints(docs, ID, TEXT, keep=keys), "prints")
    groups = materialise(simhash.fingerprint_groups(prints), "groups")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    first = prints.groupBy("fp").agg(F.min(order).alias("m")).join(groups, "fp").groupBy("group").agg(F.min("m").alias("m"))
    stays = materialise(first.select("m.k1", "m.k2"), "stays")
    gone = materialise(prints.select("k1", "k2").join(stays, ["k1", "k2"], "left_anti").distinct(), "gone")
    found, names, flag = _marked(docs, gone, stays)
    kept = found.where(~F.col(flag)).drop(*names, flag)
    again = materialise(prints.groupBy("k1", "k2").count().where("count > 1").join(stays, ["k1", "k2"], "left_semi").select("k1", "k2"), "again")
    if again.isEmpty():
        return kept
    found, names, flag = _marked(kept, again, stays)
    one = found.where(flag).dropDuplicates(names)
    return found.where(~F.col(flag)).unionByName(one).drop(*names, flag)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test window go."""
    hits = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ID, TEXT)
    hits = materialise(hits.select("k1", "k2", (F.col("n_hit") > 0).alias("hit")).distinct(), "contaminated")
    found, names, flag = _marked(docs, hits.where("hit"), hits.where("not hit"))
    return found.where(~F.col(flag)).drop(*names, flag)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: the spans found in a text are replaced by their kind; ``n_chars`` follows."""
    out = pii.redact(docs, pii.fit(docs, TEXT), TEXT)
    return out.withColumn("n_chars", F.length(TEXT).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document with the words the mix takes of it (``taken``, 0 if none): so many whole ``copies``
    and the words of ``part``. An input column of such a name becomes ``doc_<name>`` (with as many _ behind it as it
    takes to be new)."""
    new = {c: c for c in docs.columns}
    for c in _MIX:
        if c in new:
            name = f"doc_{c}"
            while name in (*new, *new.values()):
                name += "_"
            new[c] = name
    rows = docs.select(*[F.col(c).alias(n) for c, n in new.items()])
    out = mixing.apply(rows, mixing.plan(rows, ID, TEXT), ID, TEXT, names=_MIX[:4])
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("copies", whole)
    return out.withColumn("part", mixing.first_words(F.col(TEXT), F.col("taken") - F.col("copies") * F.col("size"))).select(*new.values(), *_MIX)


def lay_out(mixed: DataFrame) -> DataFrame:
    """The corpus: of each document a row per whole copy and one with its part, numbered by ``copy`` from 1; a
    document of which nothing is taken has none. ``text`` is what the row holds; ``n_chars`` follows."""
    number = "copy"
    while number in mixed.columns:
        number += "_"
    n = F.col("copies") + (F.col("part") != "").cast("long")
    rows = mixed.where(F.col("taken") > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)))))
    rows = rows.withColumn(TEXT, F.when(F.col(number) <= F.col("copies"), F.col(TEXT)).otherwise(F.col("part")))
    if "n_chars" in mixed.columns:
        rows = rows.withColumn("n_chars", F.length(TEXT).cast(mixed.schema["n_chars"].dataType))
    return rows.drop("copies", "part")


_MIX = ("size", "source_size", "target", "taken", "copies", "part")
