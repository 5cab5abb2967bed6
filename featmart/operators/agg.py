"""Declarative aggregation.

``AggSpec`` is the library's only declarative object: an ordered list of
``(name, expression, functions)`` that compiles to one ``groupBy(key).agg(...)``.  Every
aggregate is algebraic or has a partial (map-side) form, so a hot key is pre-aggregated
before the shuffle and never arrives whole in one task:

* count/size/sum/mean/min/max/var/std/skew/kurt  -> partial buffers of fixed size;
* nunique                                         -> Spark's two-phase distinct aggregation
                                                     (grouped by (key, value) first);
* median/percentile exact                         -> counted values, ranked by cumulative counts
                                                     (``quantile.percentiles``); ``exact=False``
                                                     switches to a fixed-size sketch;
* mode                                            -> (key, value) counts, then ``min_by``;
* first/last non-null in an order                 -> ``min_by``/``max_by`` over a struct
                                                     (fixed-size buffer).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.functions.exprs import sample_kurtosis, sample_skew
from featmart.functions.nulls import _c


def order_key(order: Sequence) -> Column:
    """Struct that compares like ``order`` with NULL last: an is-null flag goes before each value."""
    return F.struct(*[x.alias(f"o{i}{j}") for i, o in enumerate(order) for j, x in enumerate((_c(o).isNull(), _c(o)))])


def last_nonnull(value, order: Sequence) -> Column:
    """Value of the last row (in ``order``, NULL last) whose value is not NULL (pandas ``last``)."""
    v = _c(value)
    return F.max_by(v, F.when(v.isNotNull(), order_key(order)))


def first_nonnull(value, order: Sequence) -> Column:
    v = _c(value)
    return F.min_by(v, F.when(v.isNotNull(), order_key(order)))


def agg_fn(fn: str, c: Column, exact: bool = True, order: Sequence | None = None) -> Column:
    """One named aggregate with the pandas NULL conventions of SURVEY §1.1."""
    fn = fn.lower()
    if fn == "count":
        return F.count(c)
    if fn == "size":
        return F.count(F.lit(1))
    if fn == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if fn in ("mean", "avg"):
        return F.avg(c)
    if fn == "min":
        return F.min(c)
    if fn == "max":
        return F.max(c)
    if fn in ("std", "stddev"):
        return F.stddev_samp(c)
    if fn == "std_pop":
        return F.stddev_pop(c)
    if fn == "var":
        return F.var_samp(c)
    if fn == "var_pop":
        return F.var_pop(c)
    if fn == "nunique":
        return F.countDistinct(c)
    if fn == "median":
        return F.median(c) if exact else F.percentile_approx(c, 0.5, 10000)
    if fn == "mode":
        return F.mode(c, True)
    if fn == "skew":
        return sample_skew(c)
    if fn == "kurt":
        return sample_kurtosis(c)
    if fn == "first":
        if not order:
            raise ValueError("'first' needs an order")
        return first_nonnull(c, order)
    if fn == "last":
        if not order:
            raise ValueError("'last' needs an order")
        return last_nonnull(c, order)
    if fn == "nulls":
        return F.sum(c.isNull().cast("long"))
    raise ValueError(f"unknown aggregate {fn!r}")


class AggSpec:
    """Ordered ``(name, expression, functions)`` list that compiles to aggregate Columns.

    ``expression`` is a column name or a Spark SQL expression string (kept as text so the spec
    serialises to JSON and can be handed between jobs, S6).
    """

    def __init__(self, items: Iterable | None = None, order: Sequence[str] | None = None,
                 exact: bool = True):
        self.items: list[tuple[str, str, list[str]]] = []
        self.order = list(order or [])
        self.exact = exact
        for it in items or []:
            self.add(*it)

    def add(self, name: str, fns: Sequence[str] | str, expr: str | None = None) -> "AggSpec":
        fns = [fns] if isinstance(fns, str) else list(fns)
        self.items.append((name, expr or name, fns))
        return self

    def names(self, prefix: str = "") -> list[str]:
        return [f"{prefix}{n}_{fn}" for n, _, fns in self.items for fn in fns]

    def columns(self, prefix: str = "") -> list[Column]:
        out = []
        for name, expr, fns in self.items:
            c = F.expr(expr)
            for fn in fns:
                out.append(agg_fn(fn, c, self.exact, self.order).alias(f"{prefix}{name}_{fn}"))
        return out

    def extend_from(self, names: Sequence[str], fns: Sequence[str] = ("mean", "min", "max", "sum")) -> "AggSpec":
        """Add every child-derived column with ``fns`` for the next level up."""
        for n in names:
            self.add(n, fns, f"`{n}`")
        return self

    def to_json(self) -> str:
        return json.dumps({"items": self.items, "order": self.order, "exact": self.exact})

    @classmethod
    def from_json(cls, text: str) -> "AggSpec":
        d = json.loads(text)
        return cls([(n, fns, e) for n, e, fns in d["items"]], d.get("order"), d.get("exact", True))


_HOLISTIC = ("median", "mode")


def aggregate(df: DataFrame, key: str | Sequence[str], spec: AggSpec, prefix: str = "",
              drop_null_keys: bool = True, extra: Sequence[Column] = ()) -> DataFrame:
    """``groupBy(key).agg(spec, *extra)``; NULL keys are dropped first (pandas groupby).

    Holistic functions (median, mode) are not computed inside the group-by - that would hold a
    group's distinct values in one buffer - but by the skew-safe ``quantile.median_by`` /
    ``quantile.mode_by`` and joined back on the key (one row per key on both sides)."""
    from featmart.operators import quantile as Q
    keys = [key] if isinstance(key, str) else list(key)
    if drop_null_keys:
        for k in keys:
            df = df.filter(F.col(k).isNotNull())
    plain = AggSpec(order=spec.order, exact=spec.exact)
    holistic = []
    for name, expr, fns in spec.items:
        rest = [f for f in fns if f not in _HOLISTIC]
        if rest:
            plain.add(name, rest, expr)
        holistic += [(name, expr, f) for f in fns if f in _HOLISTIC]
    out = df.groupBy(*keys).agg(*plain.columns(prefix), *extra) if (plain.items or extra) else \
        df.select(*keys).distinct()
    for name, expr, fn in holistic:
        src = df.select(*keys, F.expr(expr).alias("_x"))
        alias = f"{prefix}{name}_{fn}"
        part = (Q.median_by(src, keys, "_x", alias, spec.exact) if fn == "median"
                else Q.mode_by(src, keys, "_x", alias))
        out = out.join(part, keys, "left")
    names = spec.names(prefix)
    others = [c for c in out.columns if c not in keys and c not in names]
    return out.select(*keys, *[F.col(f"`{n}`") for n in names + others])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    num = ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean")
    return [c for c, t in df.dtypes if (t in num or t.startswith("decimal")) and c not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in exclude]


def aggregate_all(df: DataFrame, key: str, fns: Sequence[str] = ("min", "max", "mean", "var"), prefix: str = "",
                  with_size: bool = False, exclude: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """Every numeric column (but ``exclude``) with the same functions, and ``extra`` aggregates, in one
    pass (A2, A3)."""
    cols = numeric_columns(df, exclude=[key, *exclude])
    spec = AggSpec([(c, fns, f"`{c}`") for c in cols])
    exprs = spec.columns(prefix)
    if with_size:
        exprs.append(F.count(F.lit(1)).alias(f"{prefix}size"))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*exprs, *extra)


def mixed_profile(df: DataFrame, key: str, carry: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Numeric min/max/mean/sum and string mode/nunique/count per key; ``carry`` columns are
    functionally dependent on the key and kept with ``first`` (A4).  Mode ties -> smallest.

    The string columns are counted together as (key, column, value), map-side first; mode, nunique and
    count of all of them follow from those counts, so there is no distinct aggregate and no join per
    column."""
    nums = numeric_columns(df, exclude=[key, *carry])
    strs = string_columns(df, exclude=[key, *carry])
    d = df.filter(F.col(key).isNotNull())
    spec = AggSpec([(c, ["min", "max", "mean", "sum"], f"`{c}`") for c in nums])
    out = d.groupBy(key).agg(F.count(F.lit(1)).alias("_size"), *spec.columns(prefix),
                             *[F.first(c, ignorenulls=True).alias(c) for c in carry]).drop("_size")
    if not strs:
        return out
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(strs)])
    n = d.select(F.col(key), F.explode(cells).alias("_s")).select(key, "_s.i", "_s.v").filter(F.col("v").isNotNull()) \
        .groupBy(key, "i", "v").agg(F.count(F.lit(1)).alias("_c"))
    exprs = []
    for i, c in enumerate(strs):
        here = F.col("i") == i
        exprs += [F.min_by(F.when(here, F.col("v")), F.when(here, F.struct((-F.col("_c")).alias("c"), F.col("v")))).alias(f"{prefix}{c}_mode"),
                  F.count(F.when(here, 1)).alias(f"{prefix}{c}_nunique"),
                  F.coalesce(F.sum(F.when(here, F.col("_c"))), F.lit(0)).alias(f"{prefix}{c}_count")]
    out = out.join(n.groupBy(key).agg(*exprs), key, "left")
    zero = [f"{prefix}{c}_{f}" for c in strs for f in ("nunique", "count")]
    return out.fillna(0, subset=zero)


def rollup(child: DataFrame, mid_key: str, top_key: str, spec: AggSpec,
           top_fns: Sequence[str] = ("mean", "min", "max", "sum"), mid_prefix: str = "",
           top_prefix: str = "", extra: AggSpec | None = None) -> DataFrame:
    """Two-level roll-up (A6): child rows -> one row per ``mid_key`` with ``spec`` -> one row per
    ``top_key`` where each derived column gets ``top_fns`` (plus ``extra``).

    ``mid_key`` must determine ``top_key`` (a loan belongs to one customer); grouping by both
    keeps the pair without an extra join.
    """
    mid = aggregate(child, [top_key, mid_key], spec, prefix=mid_prefix)
    top = AggSpec().extend_from(spec.names(mid_prefix), top_fns)
    if extra is not None:
        top.items.extend(extra.items)
    exprs = top.columns(top_prefix) + [F.count(F.lit(1)).alias(f"{top_prefix}n_{mid_key}")]
    return mid.groupBy(top_key).agg(*exprs)


def cond_agg_exprs(cat: str, values: Sequence, spec: AggSpec, rest: bool = True,
                   label=lambda v: str(v).lower()) -> list[Column]:
    """Aggregate expressions of ``spec`` per category value plus a null-safe remainder block
    (``fn(when(cat == v, x))``), for use inside any group-by."""
    exprs = []
    blocks = [(label(v), F.col(cat) == F.lit(v)) for v in values]
    if rest:
        blocks.append(("rest", ~F.coalesce(F.col(cat).isin(list(values)), F.lit(False))))
    for tag, cond in blocks:
        for name, expr, fns in spec.items:
            x = F.when(cond, F.expr(expr))
            for fn in fns:
                if fn == "size":
                    e = F.count(F.when(cond, F.lit(1)))
                else:
                    e = agg_fn(fn, x, spec.exact, spec.order)
                exprs.append(e.alias(f"{name}_{fn}_{tag}"))
    return exprs


def cond_agg(df: DataFrame, key: str, cat: str, values: Sequence, spec: AggSpec,
             rest: bool = True, label=lambda v: str(v).lower()) -> DataFrame:
    """One pass over ``df`` computing ``spec`` per category value plus a null-safe remainder
    block (A9, A11).  Replaces N filtered group-bys + N outer joins."""
    exprs = cond_agg_exprs(cat, values, spec, rest, label)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*exprs)


def category_count_exprs(cat: str, values: Sequence, share: bool = True, prefix: str = "") -> list[Column]:
    """Count (and share) of each category value, for use inside any group-by."""
    exprs = []
    for v in values:
        ind = F.coalesce((F.col(cat) == F.lit(v)).cast("int"), F.lit(0))
        exprs.append(F.sum(ind).cast("long").alias(f"{prefix}{cat}_{v}_count"))
        if share:
            exprs.append(F.avg(ind).alias(f"{prefix}{cat}_{v}_share"))
    return exprs


def category_counts(df: DataFrame, key: str, cat: str, values: Sequence, share: bool = True,
                    prefix: str = "") -> DataFrame:
    """One-hot then sum/mean per key, without materialising dummies."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*category_count_exprs(cat, values, share, prefix))


def dist_pack(df: DataFrame, key: str, value: str, prefix: str = "", exact: bool = True) -> DataFrame:
    """Nine statistics per key (A21): size, sum, min, median, max, mean, std (population),
    bias-corrected skew and kurtosis.  The median is the skew-safe ranked median."""
    from featmart.operators.quantile import median_by
    v = F.col(value)
    d = df.filter(F.col(key).isNotNull())
    g = d.groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{prefix}size"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{prefix}sum"),
        F.min(v).alias(f"{prefix}min"),
        F.max(v).alias(f"{prefix}max"),
        F.avg(v).alias(f"{prefix}mean"),
        F.stddev_pop(v).alias(f"{prefix}std"),
        sample_skew(v).alias(f"{prefix}skew"),
        sample_kurtosis(v).alias(f"{prefix}kurt"),
    )
    med = median_by(d, [key], value, f"{prefix}median", exact)
    return g.join(med, key, "left")


def global_scalar(df: DataFrame, agg: Column, name: str) -> DataFrame:
    """A whole-table aggregate attached to every row as a constant.

    The aggregate is one scalar (a fit step): it is computed by one distributed job whose
    result is a single value, then folded into the plan as a literal.  No cross join, no
    unpartitioned window."""
    value = df.agg(agg.alias(name)).first()[0]
    return df.withColumn(name, F.lit(value))
