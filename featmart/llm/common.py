"""Helpers shared by the text operators: written tables, size-checked broadcast, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featmart.session import checkpoint_dir

#: Rows and bytes up to which a table may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Keys (two longs) up to which ``marked`` broadcasts a filter of ``FILTER_BITS`` bits a key: 64 MB.
FILTER_KEYS = 32_000_000
FILTER_BITS = 16
SLICE_BYTES = 4 << 20
_PROBES = 6
_BLOCK_BITS = 32_768        # of Spark's bitmap functions


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage is cut, a lost
    executor costs one re-read, and the planner knows the table's real size."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: 16 a column, and what its strings and arrays hold."""
    out = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.ArrayType):
            each = F.coalesce(F.octet_length(F.array_join(c, "")), F.lit(0)) if isinstance(t.elementType, T.StringType) else F.lit(0)
            out = out + each + 16 * F.greatest(F.size(c), F.lit(0))
        elif isinstance(t, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(c), F.lit(0))
    return out


def small(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Hint a broadcast if the (already written) table has at most ``max_rows`` rows of ``max_bytes`` together;
    otherwise leave the join to the planner, which then shuffles both sides."""
    max_rows, max_bytes = max_rows or BROADCAST_ROWS, max_bytes or BROADCAST_BYTES
    got = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df)).alias("b")).first()
    return F.broadcast(df) if got["n"] <= max_rows and (got["b"] or 0) <= max_bytes else df


def _probes(names: list[str]) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(names[1]), F.lit(j)), F.lit(_BLOCK_BITS)).cast("int") for j in range(_PROBES)]


def marked(keyed: DataFrame, names: list[str], inside: DataFrame, others: DataFrame, flag: str) -> DataFrame:
    """``keyed`` with ``flag``: whether its key, two longs in the columns ``names``, is in ``inside``. ``others`` (written,
    like ``inside``) holds at least the keys of ``keyed`` that are not. Wide rows are not shuffled: few keys are broadcast;
    more as a blocked Bloom filter of ``FILTER_BITS`` bits a key, with the exact list of the other keys that pass it. Only
    beyond ``FILTER_KEYS`` keys, or where that list is too long, is it a shuffled join."""
    mine = inside.select(*names).distinct()
    n = mine.count()
    if n <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(mine.withColumn(flag, F.lit(True))), names, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    if n <= FILTER_KEYS:
        bucket, bits, known = f"{flag}_bucket", f"{flag}_bits", f"{flag}_known"
        blocks = -(-n * FILTER_BITS // _BLOCK_BITS)
        at = F.pmod(F.col(names[0]), F.lit(blocks))
        spots = mine.select(at.alias(bucket), F.explode(F.array(*_probes(names))).alias("at"))
        table = F.broadcast(materialise(spots.groupBy(bucket).agg(F.bitmap_construct_agg("at").alias(bits)), "filter"))
        passes = F.lit(True)
        for spot in _probes(names):
            byte = F.conv(F.hex(F.substring(bits, F.shiftright(spot, 3) + 1, F.lit(1))), 16, 10).cast("int")
            passes = passes & (F.getbit(byte, spot.bitwiseAND(7)) == 1)
        passes = F.coalesce(passes, F.lit(False))
        strays = others.select(*names).withColumn(bucket, at).join(table, bucket).where(passes).select(*names).distinct()
        strays = materialise(strays.join(mine, names, "left_anti"), "strays")
        if strays.count() <= BROADCAST_ROWS * 10:
            hit = keyed.withColumn(bucket, at).join(table, bucket, "left").withColumn(flag, passes).drop(bucket, bits)
            hit = hit.join(F.broadcast(strays.withColumn(known, F.lit(True))), names, "left")
            return hit.withColumn(flag, F.col(flag) & F.col(known).isNull()).drop(known)
    return keyed.join(mine.withColumn(flag, F.lit(True)), names, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df``, written, with ``name``: the row's number among the rows with equal ``keys``, from 0, in no stated order. A key
    that holds a large share of all rows is counted by partition."""
    m, p = f"{name}_m", f"{name}_p"
    t = materialise(df.withColumn(m, F.monotonically_increasing_id()), "numbered").withColumn(p, F.shiftright(m, 33))
    counts = t.groupBy(*keys, p).agg(F.count(F.lit(1)).alias(name))
    before = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*keys, p, F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name))
    here = F.row_number().over(Window.partitionBy(*keys, p).orderBy(m)) - 1
    return t.withColumn(f"{name}_here", here).join(start, [*keys, p]).withColumn(name, F.col(name) + F.col(f"{name}_here")).drop(m, p, f"{name}_here")


def small_batches(spark: SparkSession) -> None:
    """Let the session hand Python Arrow batches of ``SLICE_BYTES`` instead of the usual 64 MB: both sides of
    the exchange hold a batch or two per task outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """One Arrow batch in, one out (None: nothing). ``fn`` gets slices of about ``SLICE_BYTES``, at least
    a row, so that the Python objects it makes stay few whatever the texts' length."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, b.num_rows * SLICE_BYTES // max(b.nbytes, SLICE_BYTES)) if b.num_rows else 1
            for at in range(0, b.num_rows, step):
                out = fn(b.slice(at, step))
                if out is not None:
                    yield out
    return df.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): one row (node, root) per node
    of an edge, ``root`` being one node of its component.

    Each round points every node at the neighbour with the lowest hash (a new hash per round, so
    that ordered ids make no long chains), follows the pointer once more, and replaces the edges
    by those between what remains. Edges shrink by a constant factor a round; each round is a
    partial aggregation and three equi joins, whatever the size of a component. Null ends and
    loops are ignored; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    e = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .distinct(), "edges")
    steps = []
    while not e.isEmpty():
        def rank(c, r=len(steps)):
            return F.struct(F.xxhash64(F.col(c), F.lit(r)).alias("h"), F.col(c).alias("n"))
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b"), F.col("a")))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        parent = best.select("u", F.when(F.col("m") < rank("u"), F.col("m.n")).otherwise(F.col("u")).alias("p"))
        parent = materialise(parent, "parent")
        step = materialise(parent.join(parent.select(F.col("u").alias("p"), F.col("p").alias("q")), "p")
                           .select("u", F.col("q").alias("p")), "step")
        steps.append(step)
        e = materialise(
            e.join(step.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
            .join(step.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
            .where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    out = steps[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for s in steps[1:]:
        out = out.join(s.select(F.col("u").alias("root"), F.col("p")), "root", "left").select(
            "node", F.coalesce("p", "root").alias("root"))
    return out
