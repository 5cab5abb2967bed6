"""Projections, filters and cleaning.

Per-column rules are generated as one ``select`` over all columns (never a loop of
``withColumn`` that grows the plan one projection at a time), and statistics used for
imputation or type narrowing come from a single aggregate pass over all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.functions.nulls import finite_or_null, flag

# Missing-value sentinels used by the source data.
NUMERIC_SENTINEL = 365243
STRING_SENTINELS = ("XNA", "Unknown", "not specified", "")

_NUM_TYPES = ("int", "bigint", "double", "float", "smallint", "tinyint")


def _is_num(t: str) -> bool:
    return t in _NUM_TYPES or t.startswith("decimal")


def _is_frac(t: str) -> bool:
    return t in ("double", "float")


def project(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Replace the named columns by expressions, keeping column order (single projection)."""
    return df.select(*[rules[c].alias(c) if c in rules else F.col(f"`{c}`") for c in df.columns])


def sentinel_to_null(df: DataFrame, cols: Sequence[str], value=NUMERIC_SENTINEL) -> DataFrame:
    """A numeric sentinel becomes NULL."""
    return project(df, {c: F.when(F.col(c) == F.lit(value), None).otherwise(F.col(c)) for c in cols})


def string_sentinels_to_null(df: DataFrame, values: Iterable[str] = STRING_SENTINELS) -> DataFrame:
    """String sentinels become NULL in every string column."""
    vals = list(values)
    return project(df, {c: F.when(F.col(c).isin(vals), None).otherwise(F.col(c))
                        for c, t in df.dtypes if t == "string"})


def infinite_to_null(df: DataFrame) -> DataFrame:
    """+-inf and NaN become NULL in every fractional column."""
    return project(df, {c: finite_or_null(c) for c, t in df.dtypes if _is_frac(t)})


def infinite_to_bounds(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """+inf -> column max of finite values, -inf -> column min (one aggregate pass)."""
    cols = list(cols or [c for c, t in df.dtypes if _is_frac(t)])
    fin = {c: finite_or_null(c) for c in cols}
    stats = df.agg(*[F.max(fin[c]).alias(f"mx_{i}") for i, c in enumerate(cols)],
                   *[F.min(fin[c]).alias(f"mn_{i}") for i, c in enumerate(cols)]).first()
    rules = {}
    for i, c in enumerate(cols):
        x = F.col(c)
        rules[c] = (F.when(x == F.lit(float("inf")), F.lit(stats[f"mx_{i}"]))
                    .when(x == F.lit(float("-inf")), F.lit(stats[f"mn_{i}"])).otherwise(x))
    return project(df, rules)


def nonnegative_to_null(df: DataFrame, pattern: str = "DAYS") -> DataFrame:
    """P5: in every numeric column whose name contains ``pattern``, values >= 0 become NULL."""
    return project(df, {c: F.when(F.col(c) >= 0, None).otherwise(F.col(c))
                        for c, t in df.dtypes if pattern.lower() in c.lower() and _is_num(t)})


def cap_to_null(df: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    """Values above a cap become NULL."""
    return project(df, {c: F.when(F.col(c) > F.lit(v), None).otherwise(F.col(c)) for c, v in caps.items()})


def recode(c: str, mapping: Mapping) -> Column:
    """Value -> value, others unchanged (broadcast-free ``when`` chain for short maps)."""
    out = None
    for k, v in mapping.items():
        cond = F.col(c) == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return F.col(c) if out is None else out.otherwise(F.col(c))


def group_values(c: str, groups: Mapping[str, Sequence]) -> Column:
    """Lists of values collapsed to one label; other values unchanged."""
    out = None
    for label, vals in groups.items():
        cond = F.col(c).isin(list(vals))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.col(c) if out is None else out.otherwise(F.col(c))


def int_set_label(c: str, ranges: Sequence[tuple[int, int, str]], default: str | None = None) -> Column:
    """Integer ranges (inclusive) -> label."""
    out = None
    for lo, hi, label in ranges:
        cond = F.col(c).between(lo, hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def substring_group(c: str, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """P10: first matching substring wins."""
    out = None
    for needle, label in rules:
        cond = F.col(c).contains(needle)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.col(c) if default is None else F.lit(default))


def ordinal(c: str, levels: Sequence[str]) -> Column:
    """Ordered string levels -> 0..n-1 (NULL for unknown)."""
    m = F.create_map(*[x for i, lv in enumerate(levels) for x in (F.lit(lv), F.lit(i))])
    return m[F.col(c)]


def within_unit(c: str, unit: float = 360.0, limit: float = 1.0) -> Column:
    """``abs(c / unit) <= limit`` as 0/1; NULL gives 0."""
    return flag(F.abs(F.col(c) / F.lit(unit)) <= F.lit(limit))


def sign_flag(c: str, missing=None) -> Column:
    """>= 0 -> 1, < 0 -> 0, NULL -> ``missing``."""
    x = F.col(c)
    return F.when(x.isNull(), F.lit(missing)).when(x >= 0, F.lit(1)).otherwise(F.lit(0))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant imputation."""
    return df.fillna(dict(values))


def fill_statistic(df: DataFrame, cols: Sequence[str], how: str = "mean", exact: bool = True,
                   fit_on: Column | None = None) -> DataFrame:
    """Impute NULL with a column statistic: mean / max+1 from one aggregate pass over all
    columns; median from the skew-safe ranked percentiles (all columns in one job); mode from a
    (value, count) aggregation.

    how: mean | median | mode | max_plus_one. ``fit_on`` restricts the rows that give the statistic (the
    labelled part); all rows are filled."""
    whole, df = df, (df if fit_on is None else df.filter(fit_on))
    if not cols:
        return whole
    def stat(c):
        x = F.col(c)
        if how == "mean":
            return F.avg(x)
        if how == "max_plus_one":
            return F.max(x) + F.lit(1)
        raise ValueError(how)
    if how == "median":
        from featmart.operators.quantile import column_quantiles
        qs = column_quantiles(df, cols, [0.5], exact=exact)
        vals = {c: qs[c][0] if qs[c] else None for c in cols}
    elif how == "mode":
        from featmart.operators.quantile import mode_by
        # all columns in one unpivoted (column, value) count; equal counts go to the smallest value
        # of the column's own type, so each column keeps its typed field
        arr = F.array(*[F.struct(F.lit(i).alias("i"), *[(F.col(d) if d == c else F.lit(None).cast(dict(df.dtypes)[d])).alias(f"v{j}")
                                                          for j, d in enumerate(cols)]) for i, c in enumerate(cols)])
        u = df.select(F.explode(arr).alias("s")).select("s.i", F.struct(*[F.col(f"s.v{j}") for j in range(len(cols))]).alias("v"))
        u = u.where(" OR ".join(f"v.v{j} IS NOT NULL" for j in range(len(cols))))
        found = {r["i"]: r["m"] for r in mode_by(u, ["i"], "v", "m").collect()}
        vals = {c: found[i][f"v{i}"] if i in found else None for i, c in enumerate(cols)}
    else:
        row = df.agg(*[stat(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        vals = {c: row[f"s{i}"] for i, c in enumerate(cols)}
    return project(whole, {c: F.coalesce(F.col(c), F.lit(vals[c]).cast(dict(df.dtypes)[c])) for c in cols})


def select_by_type(df: DataFrame, kind: str) -> list[str]:
    """Column names by dtype family: 'numeric' | 'string' | 'fractional' | 'integral'."""
    if kind == "numeric":
        return [c for c, t in df.dtypes if _is_num(t)]
    if kind == "string":
        return [c for c, t in df.dtypes if t == "string"]
    if kind == "fractional":
        return [c for c, t in df.dtypes if _is_frac(t)]
    if kind == "integral":
        return [c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint")]
    raise ValueError(kind)


def select_by_pattern(df: DataFrame, pattern: str) -> list[str]:
    """Column names matching a regular expression."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c)]


def add_affixes(df: DataFrame, prefix: str = "", suffix: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """Prefix / suffix every column except the keys in ``keep``."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in keep else f"{prefix}{c}{suffix}") for c in df.columns])


def sanitize_names(df: DataFrame, mode: str = "alnum") -> DataFrame:
    """P20: 'alnum' -> every non-alphanumeric character becomes '_'; 'json' -> JSON punctuation
    is removed.  Raises if two columns collide afterwards."""
    if mode == "alnum":
        new = [re.sub(r"[^0-9A-Za-z_]", "_", c) for c in df.columns]
    else:
        new = ["".join(ch for ch in c if ch not in '{}:"\',[]') for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError("column names collide after sanitising")
    return df.toDF(*new)


def drop_duplicate_names(df: DataFrame) -> DataFrame:
    """Keep the first of columns with the same name (after a concat / merge)."""
    seen, keep = set(), []
    for i, c in enumerate(df.columns):
        if c not in seen:
            seen.add(c)
            keep.append(i)
    if len(keep) == len(df.columns):
        return df
    tmp = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return tmp.select(*[F.col(f"__c{i}").alias(df.columns[i]) for i in keep])


_INT_RANGES = [("tinyint", -(2 ** 7), 2 ** 7 - 1), ("smallint", -(2 ** 15), 2 ** 15 - 1),
               ("int", -(2 ** 31), 2 ** 31 - 1), ("bigint", -(2 ** 63), 2 ** 63 - 1)]
_FLOAT32_MAX = 3.4028234663852886e38


def narrowest_types(df: DataFrame) -> DataFrame:
    """For every numeric column, the smallest type holding its min and max (one pass).
    Returns a (column, min, max, type) table; there is no half-precision type in Spark, so the
    smallest fractional type is ``float``."""
    nums = [(c, t) for c, t in df.dtypes if _is_num(t)]
    row = df.agg(*[F.min(c).cast("double").alias(f"mn{i}") for i, (c, _) in enumerate(nums)],
                 *[F.max(c).cast("double").alias(f"mx{i}") for i, (c, _) in enumerate(nums)])
    parts = []
    for i, (c, t) in enumerate(nums):
        mn, mx = F.col(f"mn{i}"), F.col(f"mx{i}")
        if _is_frac(t):
            typ = F.when((mn > -_FLOAT32_MAX) & (mx < _FLOAT32_MAX), F.lit("float")).otherwise(F.lit("double"))
        else:
            typ = None
            for name, lo, hi in _INT_RANGES:
                cond = (mn > F.lit(lo)) & (mx < F.lit(hi))
                typ = F.when(cond, F.lit(name)) if typ is None else typ.when(cond, F.lit(name))
            typ = typ.otherwise(F.lit("bigint"))
        parts.append(F.struct(F.lit(c).alias("column"), mn.alias("min"), mx.alias("max"), typ.alias("type")))
    return row.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def narrow(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Apply chosen casts in one projection."""
    return project(df, {c: F.col(c).cast(t) for c, t in types.items()})
