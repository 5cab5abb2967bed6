"""Column-level building blocks: the NULL contract and row / moment expressions."""

from featmart.functions.nulls import (  # noqa: F401
    safe_div, pct_change, flag, ne_null_safe, finite_or_null,
    nan_to_null, half_even, log1p_guarded, pow_guarded, sqrt_guarded, trunc_int,
)
from featmart.functions.exprs import (  # noqa: F401
    row_count, row_nulls, row_sum, row_mean, row_std, row_min, row_max, row_prod_strict,
    row_kurtosis, cyclical, loan_interest, sample_skew, sample_kurtosis,
)
