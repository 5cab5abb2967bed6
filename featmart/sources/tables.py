"""Scans and sinks.

Tables are read with explicit schemas; ``inferSchema`` is only a fallback for unknown CSVs.
Column pruning and filters reach the Parquet reader because callers ``select``/``filter``
lazily on the returned frame.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Known schemas of the stand-in tables (FIXTURES §2).
SCHEMAS: dict[str, T.StructType] = {
    "region": T.StructType([T.StructField("r_regionkey", T.IntegerType()),
                            T.StructField("r_name", T.StringType())]),
    "nation": T.StructType([T.StructField("n_nationkey", T.IntegerType()),
                            T.StructField("n_name", T.StringType()),
                            T.StructField("n_regionkey", T.IntegerType())]),
    "customer": T.StructType([T.StructField("c_custkey", T.LongType()),
                              T.StructField("c_name", T.StringType()),
                              T.StructField("c_nationkey", T.IntegerType()),
                              T.StructField("c_acctbal", T.DoubleType()),
                              T.StructField("c_mktsegment", T.StringType())]),
    "orders": T.StructType([T.StructField("o_orderkey", T.LongType()),
                            T.StructField("o_custkey", T.LongType()),
                            T.StructField("o_orderstatus", T.StringType()),
                            T.StructField("o_totalprice", T.DoubleType()),
                            T.StructField("o_orderdate", T.TimestampNTZType()),
                            T.StructField("o_orderpriority", T.StringType())]),
    "lineitem": T.StructType([T.StructField("l_orderkey", T.LongType()),
                              T.StructField("l_partkey", T.LongType()),
                              T.StructField("l_suppkey", T.LongType()),
                              T.StructField("l_linenumber", T.IntegerType()),
                              T.StructField("l_quantity", T.DoubleType()),
                              T.StructField("l_extendedprice", T.DoubleType()),
                              T.StructField("l_discount", T.DoubleType()),
                              T.StructField("l_tax", T.DoubleType()),
                              T.StructField("l_returnflag", T.StringType()),
                              T.StructField("l_linestatus", T.StringType()),
                              T.StructField("l_shipdate", T.TimestampNTZType())]),
    "events": T.StructType([T.StructField("event_id", T.LongType()),
                            T.StructField("ts", T.TimestampNTZType()),
                            T.StructField("user_id", T.LongType()),
                            T.StructField("event_type", T.StringType()),
                            T.StructField("value", T.DoubleType()),
                            T.StructField("props", T.StringType())]),
    "documents": T.StructType([T.StructField("doc_id", T.LongType()),
                               T.StructField("text", T.StringType()),
                               T.StructField("lang", T.StringType()),
                               T.StructField("source", T.StringType()),
                               T.StructField("n_chars", T.LongType())]),
    "labels": T.StructType([T.StructField("doc_id", T.LongType()),
                            T.StructField("quality", T.IntegerType()),
                            T.StructField("toxic", T.IntegerType())]),
    "part": T.StructType([T.StructField("p_partkey", T.LongType()),
                          T.StructField("p_name", T.StringType()),
                          T.StructField("p_brand", T.StringType()),
                          T.StructField("p_type", T.StringType()),
                          T.StructField("p_size", T.IntegerType()),
                          T.StructField("p_retailprice", T.DoubleType())]),
    "supplier": T.StructType([T.StructField("s_suppkey", T.LongType()),
                              T.StructField("s_name", T.StringType()),
                              T.StructField("s_nationkey", T.IntegerType()),
                              T.StructField("s_acctbal", T.DoubleType())]),
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan of a stand-in table; ``columns`` prunes at the reader."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             drop_index: bool = True) -> DataFrame:
    """CSV with header (S1); explicit schema when known, inference otherwise.  A stray unnamed
    index column (``_c0`` or empty header) is dropped (S4)."""
    reader = spark.read.option("header", True).option("nullValue", "").option("mode", "FAILFAST")
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = reader.option("inferSchema", True).csv(path)
    if drop_index:
        stray = [c for c in df.columns if c in ("_c0", "", "Unnamed: 0")]
        if stray:
            df = df.drop(*stray)
    return df


_TYPES = ["int", "bigint", "double", "date", "timestamp_ntz", "boolean"]


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The rows of a CSV with header as text columns, a broken row with its line in ``_line``, each with its file."""
    names = spark.read.option("header", True).csv(path).columns            # reads the first line
    raw = T.StructType([*[T.StructField(c, T.StringType()) for c in names], T.StructField("_line", T.StringType())])
    reader = spark.read.schema(raw).option("header", True).option("nullValue", "").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
    # a row's fields are counted only if all columns are parsed
    d = reader.option("columnPruning", False).csv(path).withColumn("_file", F.col("_metadata.file_path"))
    return d, names


def infer_types(rows: DataFrame, names: list[str], tolerance: float) -> dict[str, str]:
    """The narrowest type that all but a share ``tolerance`` of a column's values can be cast to; one aggregate for all columns."""
    def can(c, t):
        return F.count(F.expr(f"try_cast(`{c}` AS {t})"))
    got = rows.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(names)],
                   *[can(c, t).alias(f"c{i}_{j}") for i, c in enumerate(names) for j, t in enumerate(_TYPES)]).first()
    out = {}
    for i, c in enumerate(names):
        n = got[f"n{i}"]
        out[c] = next((t for j, t in enumerate(_TYPES) if n and got[f"c{i}_{j}"] >= (1 - tolerance) * n), "string")
    return out


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | None = None, quarantine: str | None = None,
                     tolerance: float = 0.05, drop_index: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of a CSV with header that may hold broken rows (S1, S4): a row with too few or too many fields, or with
    a value that is not of its column's type, goes to ``bad`` (file, reason, line) and does not end the read.

    Without ``schema`` the types come from one pass over the whole file (``infer_types``); ``tolerance`` is the share of
    values that may be broken. A stray unnamed index column is dropped. With ``quarantine`` the bad rows are written there."""
    d, names = _lines(spark, path)
    whole = F.col("_line").isNull()
    types = {f.name: f.dataType.simpleString() for f in schema.fields} if schema is not None else infer_types(d.where(whole), names, tolerance)
    stray = [c for c in names if c in ("_c0", "", "Unnamed: 0")] if drop_index else []
    types = {c: types.get(c, "string") for c in names}
    cast = {c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in types.items()}
    faults = F.concat_ws("; ", *[F.when(F.col(f"`{c}`").isNotNull() & cast[c].isNull(), F.lit(f"{c}: not {t}")) for c, t in types.items() if t != "string"])
    reason = F.when(~whole, F.lit(f"not {len(names)} fields")).when(faults != "", faults)
    d = d.withColumn("_reason", reason)
    rows = d.where(F.col("_reason").isNull()).select(*[cast[c].alias(c) for c in names if c not in stray])
    line = F.coalesce("_line", F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names]))
    bad = d.where(F.col("_reason").isNotNull()).select(F.col("_file").alias("file"), F.col("_reason").alias("reason"), line.alias("line"))
    if quarantine:
        bad.write.mode("overwrite").parquet(quarantine)
        bad = spark.read.parquet(quarantine)
    return rows, bad


def limit_rows(df: DataFrame, nrows: int | None) -> DataFrame:
    """Row-limited scan (S3); ``None`` reads everything."""
    return df if nrows is None else df.limit(nrows)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Parquet / CSV sink (S5).  Writes go through Spark's commit protocol, so a lost executor's
    task is retried without leaving partial files."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_scores(df: DataFrame, id_col: str, score_col: str, path: str) -> None:
    """Scored-file sink (S8): id as 32-bit int plus probability."""
    write_table(df.select(F.col(id_col).cast("int").alias(id_col), F.col(score_col).cast("double")),
                path, fmt="csv")


def save_json(spark: SparkSession, obj, path: str) -> None:
    """Small artefacts (aggregate specs, fitted parameters) as one JSON line on the session's file system,
    so another job on any node can read them (S6)."""
    spark.createDataFrame([(json.dumps(obj, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()["value"])


def save_vectors(df: DataFrame, path: str, columns: list[str]) -> None:
    """Id / label / fold vectors as a Parquet table, for jobs that train on the same split."""
    write_table(df.select(*columns), path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def split_by_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled) parts by label nullness."""
    return df.filter(F.col(label).isNotNull()), df.filter(F.col(label).isNull())
