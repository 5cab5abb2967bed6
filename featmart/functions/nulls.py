"""The NULL / NaN / zero-division contract in one place.

Every helper returns a ``Column`` built from JVM-side expressions, so it stays inside
whole-stage codegen.  Rules:

* missing is always SQL NULL (NaN is converted on ingest with :func:`nan_to_null`);
* ``x / 0`` is NULL (``try_divide``; plain ``/`` raises under ANSI mode);
* comparisons involving NULL give flag 0 (:func:`flag`);
* ``!=`` against a value is null-safe: NULL is "not equal" (:func:`ne_null_safe`);
* rounding of halves is to even (:func:`half_even`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b with NULL for a zero or NULL denominator."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def pct_change(new: ColumnOrName, base: ColumnOrName) -> Column:
    """100 * (new - base) / base, NULL when base is 0."""
    return safe_div(_c(new) - _c(base), base) * F.lit(100.0)


def flag(cond: Column) -> Column:
    """Boolean condition -> 0/1 int; NULL comparisons count as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def ne_null_safe(c: ColumnOrName, value) -> Column:
    """``c != value`` where NULL counts as "not equal" (pandas ``!=`` with NaN)."""
    return ~_c(c).eqNullSafe(F.lit(value))


def finite_or_null(c: ColumnOrName) -> Column:
    """+-inf and NaN -> NULL."""
    col = _c(c)
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(None)).otherwise(col)


def nan_to_null(c: ColumnOrName) -> Column:
    col = _c(c)
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def half_even(c: ColumnOrName, digits: int = 0) -> Column:
    """Round halves to even (numpy/pandas ``round``)."""
    return F.bround(_c(c).cast("double"), digits)


def log1p_guarded(c: ColumnOrName) -> Column:
    """log(1 + x), NULL outside the domain x > -1."""
    col = _c(c)
    return F.when(col > F.lit(-1.0), F.log1p(col))


def pow_guarded(c: ColumnOrName, p: float) -> Column:
    """x ** p, NULL where the result would be infinite or NaN (x < 0 for fractional p, x <= 0 for
    negative p); 0 ** p is 0 for p > 0."""
    col = _c(c).cast("double")
    if float(p).is_integer() and p > 0:
        return F.pow(col, F.lit(float(p)))
    return F.when(col >= F.lit(0.0) if p > 0 else col > F.lit(0.0), F.pow(col, F.lit(float(p))))


def sqrt_guarded(c: ColumnOrName) -> Column:
    col = _c(c)
    return F.when(col >= F.lit(0.0), F.sqrt(col))


def trunc_int(c: ColumnOrName) -> Column:
    """Truncation toward zero (``astype(int)``)."""
    return _c(c).cast("long")
