"""Joins and set operations.

Broadcast policy
----------------
* Ordinary joins carry no hint: AQE measures the materialised shuffle stage and switches to a
  broadcast join only below ``spark.sql.adaptive.autoBroadcastJoinThreshold`` - a size check
  made at run time, with sort-merge as the path beyond it.
* AQE still shuffles the large side before it knows. Where that side holds detail rows and the other is a fitted table, written
  already and mostly tiny, ``few_rows`` counts it and hints a broadcast if it is.
* ``collect_bounded`` fetches parameter tables that are bounded by construction (a row per column or per bin).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def collect_bounded(df: DataFrame, bound: int, what: str = "fitted table") -> list:
    """Collect a small parameter table to the driver, refusing if it has more than ``bound``
    rows (fetches at most ``bound + 1`` rows, so an oversized table is never pulled whole)."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows; bucket the input or raise the bound")
    return rows


def few_rows(df: DataFrame, bound: int = 50_000) -> DataFrame:
    """``df``, a written table of narrow rows, with a broadcast hint if it has at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def attach(parent: DataFrame, child_agg: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join an already aggregated child (one row per key) onto its parent."""
    return parent.join(child_agg, on=on, how=how)


def aggregate_and_attach(parent: DataFrame, child: DataFrame, key: str, exprs: list) -> DataFrame:
    """Aggregate first, then left-join (J7): the child is reduced to one row per key before the
    join, so the join never multiplies child rows."""
    agg = child.filter(F.col(key).isNotNull()).groupBy(key).agg(*exprs)
    return parent.join(agg, on=key, how="left")


def star_join(base: DataFrame, key: str, marts: Sequence[DataFrame], how: str = "left") -> DataFrame:
    """Chain of joins of per-entity marts onto a base table.

    Every mart is keyed by ``key``; they are hash-partitioned on it by their own aggregation,
    so the sort-merge joins reuse that partitioning (EnsureRequirements adds no exchange when
    the child is already hash-partitioned by the key with the session's partition count)."""
    out = base
    for m in marts:
        dup = [c for c in m.columns if c != key and c in out.columns]
        if dup:
            raise ValueError(f"duplicate feature names in star join: {dup[:5]}")
        out = out.join(m, on=key, how=how)
    return out


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key appears in ``ids``."""
    return df.join(ids.select(key), on=key, how="left_semi")


def anti(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not appear in ``ids``."""
    return df.join(ids.select(key), on=key, how="left_anti")


def union_named(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name, missing columns filled with NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def group_stat_on_rows(df: DataFrame, keys: Sequence[str], exprs: dict) -> DataFrame:
    """Group statistics attached to every detail row.

    Written as aggregate + equi-join rather than ``agg.over(Window.partitionBy(keys))``: the
    aggregate is pre-combined map-side, and the join side is one row per key, so a hot key is
    split by AQE's skew-join handling instead of landing whole in one window task.
    ``exprs`` maps output name -> aggregate Column."""
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in exprs.items()])
    return df.join(stats, on=list(keys), how="left")
