"""Row-wise and moment expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from featmart.functions.nulls import _c, safe_div

# ---------------------------------------------------------------- row-wise statistics (skip NULL)


def _present(cols: Sequence) -> Column:
    return sum((_c(c).isNotNull().cast("int") for c in cols), F.lit(0))


def row_count(cols: Sequence) -> Column:
    """Number of non-NULL values among ``cols``."""
    return _present(cols)


def row_nulls(cols: Sequence) -> Column:
    """Number of NULL values among ``cols``."""
    return sum((_c(c).isNull().cast("int") for c in cols), F.lit(0))


def row_sum(cols: Sequence) -> Column:
    """Sum skipping NULL; 0 when all are NULL (pandas ``sum(axis=1)``)."""
    return sum((F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))


def row_mean(cols: Sequence) -> Column:
    s = sum((F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    return safe_div(s, _present(cols))


def _deviation_sum(cols: Sequence, mean: Column, k: int) -> Column:
    """Sum of (x - mean) ** k over the non-NULL values: the mean goes off first, so large values do not cancel."""
    return sum((F.coalesce(F.pow(_c(c).cast("double") - mean, F.lit(float(k))), F.lit(0.0)) for c in cols), F.lit(0.0))


def _flat(spread: Column, size: Column) -> Column:
    """Whether a sum or mean of squared deviations is rounding only, measured against the values' size."""
    return spread <= F.pow(F.lit(1e-14) * size, 2)


def row_std(cols: Sequence) -> Column:
    """Sample standard deviation (ddof=1) skipping NULL; NULL with fewer than two values."""
    n = _present(cols).cast("double")
    # try_divide: ANSI mode raises on x / 0 even inside a branch that is not taken once
    # subexpressions are shared, so every division by a count is guarded
    var = F.try_divide(_deviation_sum(cols, row_mean(cols), 2), n - F.lit(1.0))
    return F.when(n >= 2, F.sqrt(var))


def row_min(cols: Sequence) -> Column:
    return F.least(*[_c(c) for c in cols])


def row_max(cols: Sequence) -> Column:
    return F.greatest(*[_c(c) for c in cols])


def row_prod_strict(cols: Sequence) -> Column:
    """Product where any NULL makes the result NULL (C11)."""
    out = _c(cols[0]).cast("double")
    for c in cols[1:]:
        out = out * _c(c)
    return out


def row_prod(cols: Sequence) -> Column:
    """Product skipping NULL; 1 when all are NULL (pandas ``prod(axis=1)``, C10)."""
    out = F.lit(1.0)
    for c in cols:
        out = out * F.coalesce(_c(c).cast("double"), F.lit(1.0))
    return out


def row_kurtosis(cols: Sequence) -> Column:
    """Bias-corrected excess kurtosis across columns (pandas ``kurt(axis=1)``): NULL for fewer than
    four values, 0 for a constant row."""
    n = _present(cols).cast("double")
    mean = row_mean(cols)
    s2, s4 = _deviation_sum(cols, mean, 2), _deviation_sum(cols, mean, 4)
    size = F.greatest(*[F.abs(_c(c).cast("double")) for c in cols])
    g2 = F.try_divide(n * s4, s2 * s2) - F.lit(3.0)
    big = F.try_divide(((n + 1) * g2 + 6) * (n - 1), (n - 2) * (n - 3))
    return F.when(n >= 4, F.when(_flat(s2, size), F.lit(0.0)).otherwise(big))


# ---------------------------------------------------------------- transforms


def cyclical(c, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*c/period."""
    ang = _c(c).cast("double") * F.lit(2.0 * math.pi / period)
    return F.sin(ang), F.cos(ang)


def loan_interest(annuity, n_payments, credit) -> tuple[Column, Column, Column]:
    """Total interest, annualised rate 2*12*I/(credit*(n+1)), interest share of credit."""
    interest = _c(annuity) * _c(n_payments) - _c(credit)
    rate = safe_div(F.lit(24.0) * interest, _c(credit) * (_c(n_payments) + F.lit(1.0)))
    share = safe_div(interest, credit)
    return interest, rate, share


# ---------------------------------------------------------------- moment corrections (aggregates)


def sample_skew(c) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``skew``); NULL when n < 3, 0 for a constant group."""
    col = _c(c)
    n = F.count(col).cast("double")
    g1 = F.try_divide(F.skewness(col) * F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.when(_flat(F.var_pop(col), F.max(F.abs(col))), F.lit(0.0)).otherwise(g1))


def sample_kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``kurt``); NULL when n < 4, 0 for a constant group."""
    col = _c(c)
    n = F.count(col).cast("double")
    g2 = F.try_divide(((n + 1) * F.kurtosis(col) + 6) * (n - 1), (n - 2) * (n - 3))
    return F.when(n >= 4, F.when(_flat(F.var_pop(col), F.max(F.abs(col))), F.lit(0.0)).otherwise(g2))
