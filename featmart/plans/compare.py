"""Comparison rounding shared by the catalogue's Spark queries and their SQL oracles.

Float results of two engines differ in the last bits (summation order, Welford vs two-pass). Both
sides therefore round every DOUBLE result half up to 9 significant digits. Exact decimal halves are
common in means of money and may lie one bit to either side of the half, so the rounding goes through
12 significant digits first, which takes the last bits away; both steps are integer steps on the scaled
value, the same IEEE operations in both engines. No value is changed otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sig_col(c):
    """Spark side of the rounding to 9 significant digits."""
    x = F.col(c) if isinstance(c, str) else c
    m = F.abs(x)
    k = F.floor(F.log10(m))
    up, down = F.pow(F.lit(10.0), k), F.pow(F.lit(10.0), -k)
    scaled = F.when(k >= 0, m / up).otherwise(m * down)                      # 1 <= scaled < 10
    twelve = F.floor(scaled * F.lit(1e11) + F.lit(0.5)).cast("double")
    nine = F.floor((twelve + F.lit(500.0)) / F.lit(1000.0)).cast("double")      # nine digits as a whole number
    # one division or product by an exact power of ten: the double nearest to the decimal
    y = F.when(k <= 8, nine / F.pow(F.lit(10.0), F.lit(8) - k)).otherwise(nine * F.pow(F.lit(10.0), k - F.lit(8)))
    return (F.when(x.isNull(), F.lit(None).cast("double")).when(x == 0, F.lit(0.0))
            .when(x < 0, -y).otherwise(y) + F.lit(0.0))


def normalize(df: DataFrame) -> DataFrame:
    """Round every double/float column of a result to 9 significant digits."""
    out = []
    for name, typ in df.dtypes:
        if typ in ("double", "float"):
            out.append(sig_col(F.col(f"`{name}`").cast("double")).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return df.select(*out)


def rs(expr: str) -> str:
    """SQL (DuckDB) side of the same rounding, for an expression already of type DOUBLE."""
    x = f"CAST(({expr}) AS DOUBLE)"
    m = f"abs({x})"
    k = f"floor(log10({m}))"
    up, down = f"pow(10.0::DOUBLE, {k})", f"pow(10.0::DOUBLE, -{k})"
    scaled = f"(CASE WHEN {k} >= 0 THEN {m} / {up} ELSE {m} * {down} END)"
    nine = f"floor((floor({scaled} * 1e11 + 0.5::DOUBLE) + 500.0::DOUBLE) / 1000.0::DOUBLE)"
    y = f"(CASE WHEN {k} <= 8 THEN {nine} / pow(10.0::DOUBLE, 8 - {k}) ELSE {nine} * pow(10.0::DOUBLE, {k} - 8) END)"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN 0.0 "
            f"ELSE (CASE WHEN {x} < 0 THEN -1.0 ELSE 1.0 END) * {y} END + 0.0)")


def rsa(expr: str, alias: str) -> str:
    return f"{rs(expr)} AS {alias}"
