"""Statistics of fitted tree ensembles from their stored node tables (Q8, Q9).

A saved ensemble has a row per node. Which feature splits how often, what its splits gain and how many training rows
pass them is an aggregate over that table, whatever the ensemble's size; the impurity importances that Spark
reports follow from it as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featmart.session import checkpoint_dir


def stored_nodes(model, path: str | None = None) -> tuple[DataFrame, str]:
    """Save ``model`` (to the shared folder if no ``path``) and return its node table and the path."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = path or f"{checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    return node_table(spark, path), path


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """(tree, node, feature, threshold, gain, cover, left, right) of a saved ensemble; ``feature`` is NULL at leaves."""
    d = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    inner = F.col("leftChild") >= 0
    return d.select(F.col("treeID").alias("tree"), F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
                    F.when(inner & (F.col("split.numCategories") < 0), F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
                    F.when(inner, F.col("gain")).alias("gain"), F.col("rawCount").alias("cover"), F.when(inner, F.col("leftChild")).alias("left"),
                    F.when(inner, F.col("rightChild")).alias("right"))


def split_statistics(nodes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, n_splits, n_trees, gain, cover) for every column: its splits, the trees that use it, the sums of gain and of
    rows over its splits; zeros for a column that no split uses."""
    g = nodes.where("feature IS NOT NULL").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_splits"), F.countDistinct("tree").alias("n_trees"), F.sum("gain").alias("gain"), F.sum("cover").alias("cover"))
    names = nodes.sparkSession.createDataFrame(list(enumerate(cols)), "i int, name string")
    zero = F.lit(0).cast("long")
    return names.join(g, F.col("i") == F.col("feature"), "left").select(
        F.col("name").alias("feature"), F.coalesce("n_splits", zero).alias("n_splits"), F.coalesce("n_trees", zero).alias("n_trees"),
        F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("cover", zero).alias("cover"))


def gain_importances(nodes: DataFrame, cols: Sequence[str], per_tree: bool) -> DataFrame:
    """(feature, importance): the share of a column's gains weighted by the rows at its splits; with ``per_tree`` (forests)
    each tree's shares count alike."""
    g = nodes.where("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("cover")).alias("g"))
    if per_tree:
        g = g.join(g.groupBy("tree").agg(F.sum("g").alias("t")), "tree").withColumn("g", F.try_divide("g", "t"))
    g = g.groupBy("feature").agg(F.sum("g").alias("g"))
    total = g.agg(F.sum("g")).first()[0] or 1.0
    names = nodes.sparkSession.createDataFrame(list(enumerate(cols)), "i int, name string")
    return names.join(g, F.col("i") == F.col("feature"), "left").select(F.col("name").alias("feature"), (F.coalesce("g", F.lit(0.0)) / total).alias("importance"))
