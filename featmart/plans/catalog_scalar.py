"""Catalogue: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from featmart.functions import exprs as X
from featmart.functions import nulls as N
from featmart.plans.compare import rs
from featmart.plans.registry import query
from featmart.sources import load


@query("ratio_pack", f"""
SELECT l_orderkey, l_linenumber,
  {rs('l_extendedprice / nullif(l_quantity, 0)')} AS unit_price,
  {rs('l_extendedprice / nullif(l_discount, 0)')} AS price_per_discount,
  {rs('l_extendedprice - l_extendedprice * (1 - l_discount)')} AS discount_amount,
  {rs('(l_extendedprice * (1 - l_discount) - l_extendedprice) / nullif(l_extendedprice, 0) * 100')} AS net_pct_change,
  {rs('(l_extendedprice * (1 + l_tax) / l_quantity) * l_quantity - l_extendedprice')} AS interest,
  {rs('(24.0 * ((l_extendedprice * (1 + l_tax) / l_quantity) * l_quantity - l_extendedprice)) / nullif(l_extendedprice * (l_quantity + 1.0), 0)')} AS interest_rate,
  {rs('((l_extendedprice * (1 + l_tax) / l_quantity) * l_quantity - l_extendedprice) / nullif(l_extendedprice, 0)')} AS interest_share
FROM lineitem
""")
def q_ratio_pack(spark, sf):
    """Ratios with NULL for a zero denominator, differences, percent change, loan interest
    terms (C1-C5)."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity",
                                      "l_discount", "l_tax"])
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    net = price * (F.lit(1) - F.col("l_discount"))
    annuity = N.safe_div(price * (F.lit(1) + F.col("l_tax")), qty)
    interest, rate, share = X.loan_interest(annuity, qty, price)
    return li.select("l_orderkey", "l_linenumber",
                     N.safe_div(price, qty).alias("unit_price"),
                     N.safe_div(price, "l_discount").alias("price_per_discount"),
                     (price - net).alias("discount_amount"),
                     N.pct_change(net, price).alias("net_pct_change"),
                     interest.alias("interest"), rate.alias("interest_rate"), share.alias("interest_share"))


@query("transform_pack", f"""
SELECT event_id,
  {rs('CASE WHEN value >= 0 THEN sqrt(value) END')} AS value_sqrt,
  {rs('pow(greatest(value - 50, 0), 0.25)')} AS value_root4,
  {rs('pow(value, 2)')} AS value_sq,
  {rs('CASE WHEN value > -1 THEN ln(1 + value) END')} AS value_log1p,
  {rs('sin(hour(ts) * (2 * pi() / 24))')} AS hour_sin,
  {rs('cos(hour(ts) * (2 * pi() / 24))')} AS hour_cos,
  {rs('round_even(value / 30.0, 0)')} AS months_half_even,
  CAST(floor(date_diff('day', TIMESTAMP '2024-01-15 00:00:00', ts) / 7.0) AS BIGINT) AS weeks_floor,
  CAST(trunc(value) AS BIGINT) AS value_trunc,
  {rs('abs(value - 250)')} AS value_dist
FROM events
""")
def q_transform_pack(spark, sf):
    """Guarded roots / powers / log1p, cyclical hour encoding, half-even rounding, floor
    division, truncation, abs (C6-C9)."""
    e = load(spark, sf, "events", ["event_id", "ts", "value"])
    s, c = X.cyclical(F.hour("ts"), 24.0)
    days = F.datediff(F.col("ts"), F.lit("2024-01-15").cast("date"))
    return e.select("event_id",
                    N.sqrt_guarded("value").alias("value_sqrt"),
                    N.pow_guarded(F.greatest(F.col("value") - 50, F.lit(0.0)), 0.25).alias("value_root4"),
                    N.pow_guarded("value", 2).alias("value_sq"),
                    N.log1p_guarded("value").alias("value_log1p"),
                    s.alias("hour_sin"), c.alias("hour_cos"),
                    N.half_even(F.col("value") / F.lit(30.0)).alias("months_half_even"),
                    F.floor(days / F.lit(7.0)).alias("weeks_floor"),
                    N.trunc_int("value").alias("value_trunc"),
                    F.abs(F.col("value") - F.lit(250)).alias("value_dist"))


_RC = ["q", "d", "t"]
_RS_SQL = "CAST(l_quantity AS DOUBLE) AS q, nullif(l_discount, 0) AS d, nullif(l_tax, 0) AS t, CAST(l_linenumber AS DOUBLE) AS ln, CAST(l_partkey % 5 AS DOUBLE) AS pk"


def _cnt(cols):
    return " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols)


_RL = "list_filter([q, d, t], lambda x: x IS NOT NULL)"
_KL = "list_filter([q, round(d * 100, 0), round(t * 100, 0), ln], lambda x: x IS NOT NULL)"
_SMALL = "[q, ln, pk]"      # the deviation does not depend on the offset that the query adds


@query("row_stats", f"""
WITH r AS (SELECT l_orderkey, l_partkey, {_RS_SQL} FROM lineitem)
SELECT l_orderkey, l_partkey,
  {rs('coalesce(q, 0.0) + coalesce(d, 0.0) + coalesce(t, 0.0)')} AS row_sum,
  {rs(f'(coalesce(q, 0.0) + coalesce(d, 0.0) + coalesce(t, 0.0)) / nullif({_cnt(_RC)}, 0)')} AS row_mean,
  {rs(f"CASE WHEN len({_RL}) >= 2 THEN list_aggregate({_RL}, 'stddev_samp') END")} AS row_std,
  {rs(f"list_aggregate({_SMALL}, 'stddev_samp')")} AS row_std_large,
  {rs('least(q, d, t)')} AS row_min, {rs('greatest(q, d, t)')} AS row_max,
  CAST(q IS NULL AS INTEGER) + CAST(d IS NULL AS INTEGER) + CAST(t IS NULL AS INTEGER) AS row_nulls,
  {rs('q * d * t')} AS row_prod,
  {rs("coalesce(q, 1.0) * coalesce(d, 1.0) * coalesce(t, 1.0)")} AS row_prod_skip,
  {rs(f"CASE WHEN len({_KL}) < 4 THEN NULL WHEN list_min({_KL}) = list_max({_KL}) THEN 0.0 ELSE list_aggregate({_KL}, 'kurtosis') END")} AS row_kurt,
  {rs("0.0 * q")} AS row_kurt_flat,
  CAST(q > 25 AS INTEGER) + CAST(coalesce(d > 0.05, false) AS INTEGER) + CAST(coalesce(t > 0.04, false) AS INTEGER) AS flag_score
FROM r
""")
def q_row_stats(spark, sf):
    """Row-wise sum/mean/std/min/max skipping NULL, NULL count, strict product, kurtosis across
    columns, product skipping NULL, additive flag score (C10-C14).  NULLs come from zero discount / tax."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax",
                                      "l_linenumber"]).select(
        "l_orderkey", "l_partkey", F.col("l_quantity").alias("q"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("d"),
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("t"), F.col("l_linenumber").alias("ln"),
        (F.col("l_partkey") % 5).alias("pk"))
    cols = ["q", "d", "t"]
    kc = [F.col("q"), F.round(F.col("d") * 100, 0), F.round(F.col("t") * 100, 0), F.col("ln")]
    return li.select("l_orderkey", "l_partkey",
                     X.row_sum(cols).alias("row_sum"), X.row_mean(cols).alias("row_mean"),
                     X.row_std(cols).alias("row_std"),
                     X.row_std([F.col(c) + 1e9 for c in ("q", "ln", "pk")]).alias("row_std_large"), X.row_prod(cols).alias("row_prod_skip"),
                     X.row_kurtosis([F.col("q") * 1.1] * 5).alias("row_kurt_flat"), X.row_min(cols).alias("row_min"),
                     X.row_max(cols).alias("row_max"), X.row_nulls(cols).alias("row_nulls"),
                     X.row_prod_strict(cols).alias("row_prod"), X.row_kurtosis(kc).alias("row_kurt"),
                     (N.flag(F.col("q") > 25) + N.flag(F.col("d") > 0.05) + N.flag(F.col("t") > 0.04))
                     .alias("flag_score"))


@query("flag_pack", """
SELECT CAST(coalesce(l_quantity > 25, false) AS INTEGER) AS big_qty,
       CAST(coalesce(l_extendedprice > l_quantity * 1000, false) AS INTEGER) AS pricey,
       CAST(coalesce(l_returnflag = 'R' AND l_linestatus = 'F', false) AS INTEGER) AS returned_closed,
       CAST(nullif(l_discount, 0) IS NULL AS INTEGER) AS no_discount,
       l_returnflag || '_' || l_linestatus AS flag_status,
       xor(l_linenumber, CAST(l_partkey % 8 AS INTEGER)) AS line_xor,
       count(*) AS n
FROM lineitem GROUP BY ALL
""")
def q_flag_pack(spark, sf):
    """Comparison flags (to a constant and column-to-column), conjunction, NULL indicator,
    category concatenation, bitwise XOR (C15-C19)."""
    li = load(spark, sf, "lineitem", ["l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus",
                                      "l_discount", "l_linenumber", "l_partkey"])
    f = li.select(
        N.flag(F.col("l_quantity") > 25).alias("big_qty"),
        N.flag(F.col("l_extendedprice") > F.col("l_quantity") * 1000).alias("pricey"),
        N.flag((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("returned_closed"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).isNull().cast("int").alias("no_discount"),
        F.concat(F.col("l_returnflag"), F.lit("_"), F.col("l_linestatus")).alias("flag_status"),
        F.col("l_linenumber").bitwiseXOR((F.col("l_partkey") % 8).cast("int")).alias("line_xor"))
    return f.groupBy(*f.columns).agg(F.count(F.lit(1)).alias("n"))
