"""Catalogue: the flagship customer mart and the D-marts."""

from __future__ import annotations

from featmart.plans.compare import normalize, rs
from featmart.plans.marts import LATE_DAYS, customer_mart
from featmart.plans.registry import query
from featmart.sources import load


def _agg_sql(cols, fns, prefix, int_cols=()):
    out = []
    for c in cols:
        for fn in fns:
            if fn == "sum":
                if c in int_cols:
                    e = f"CAST(coalesce(sum({c}), 0) AS BIGINT)"
                    out.append(f"{e} AS {prefix}{c}_{fn}")
                    continue
                e = f"coalesce(sum({c}), 0)"
            elif fn == "mean":
                e = f"avg({c})"
            else:
                e = f"{fn}({c})"
            if fn in ("min", "max") and c in int_cols:
                out.append(f"{e} AS {prefix}{c}_{fn}")
            else:
                out.append(f"{rs(e)} AS {prefix}{c}_{fn}")
    return ",\n  ".join(out)


_TOP = ["o_totalprice", "n_lines", "line_sum", "line_mean", "line_max", "returned_share",
        "discount_mean", "late", "lines_to_total"]

CUSTOMER_MART_SQL = f"""
WITH li AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice) AS line_sum,
         avg(l_extendedprice) AS line_mean, max(l_extendedprice) AS line_max,
         avg(CAST(l_returnflag = 'R' AS INT)) AS returned_share, avg(l_discount) AS discount_mean,
         max(l_shipdate) AS ship_max
  FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey),
loans AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, coalesce(li.n_lines, 0) AS n_lines,
         li.line_sum, li.line_mean, li.line_max, li.returned_share, li.discount_mean,
         CASE WHEN date_diff('day', CAST(o.o_orderdate AS DATE), CAST(li.ship_max AS DATE)) > {LATE_DAYS}
              THEN 1 ELSE 0 END AS late,
         li.line_sum / nullif(o.o_totalprice, 0) AS lines_to_total
  FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey),
pc AS (
  SELECT o_custkey,
  {_agg_sql(_TOP, ["mean", "min", "max", "sum"], "ord_", int_cols=("n_lines", "late"))},
  count(*) AS ord_count,
  coalesce(sum(o_totalprice), 0) AS tot_sum, coalesce(sum(late), 0) AS late_sum
  FROM loans WHERE o_custkey IS NOT NULL GROUP BY o_custkey)
SELECT c.c_custkey, {rs("c.c_acctbal")} AS c_acctbal, c.c_mktsegment,
  pc.* EXCLUDE (o_custkey, tot_sum, late_sum),
  {rs("c.c_acctbal / nullif(pc.tot_sum, 0)")} AS bal_to_spend,
  {rs("pc.late_sum / nullif(pc.ord_count, 0)")} AS late_share
FROM customer c LEFT JOIN pc ON c.c_custkey = pc.o_custkey
"""


@query("customer_mart", CUSTOMER_MART_SQL)
def q_customer_mart(spark, sf):
    """Flagship: lineitem -> order -> customer roll-up with ratios."""
    return customer_mart(load(spark, sf, "customer"), load(spark, sf, "orders"), load(spark, sf, "lineitem"))


# =====================================================================================
# D1-D11
# =====================================================================================

from pyspark.sql import functions as F  # noqa: E402

from featmart.plans import binning_sql as BS  # noqa: E402
from featmart.plans import marts as M  # noqa: E402
from featmart.plans.catalog_seq import LOOKALIKE_SQL  # noqa: E402

_BETA = repr(1 - 0.7)


def _rowstats_sql(parts):
    cnt = " + ".join(f"CAST(({p}) IS NOT NULL AS INTEGER)" for p in parts)
    s1 = " + ".join(f"coalesce(CAST(({p}) AS DOUBLE), 0.0)" for p in parts)
    s2 = " + ".join(f"coalesce(pow(CAST(({p}) AS DOUBLE), 2), 0.0)" for p in parts)
    n = f"CAST(({cnt}) AS DOUBLE)"
    mean = f"({s1}) / nullif({cnt}, 0)"
    std = f"CASE WHEN {n} >= 2 THEN sqrt(greatest((({s2}) - ({s1}) * ({s1}) / {n}) / ({n} - 1.0), 0.0)) END"
    mx = f"greatest({', '.join(parts)})"
    return f"{rs(mean)} AS row_mean, {rs(mx)} AS row_max, {rs(std)} AS row_std"


D1_SQL = f"""
WITH c AS (SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, n.n_name
           FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
m1 AS (SELECT c_nationkey, c_mktsegment, median(c_acctbal) AS med_ns FROM c GROUP BY 1, 2),
m2 AS (SELECT c_mktsegment, median(c_acctbal) AS med_s FROM c GROUP BY 1)
SELECT c.c_custkey, c.n_name, c.c_mktsegment,
  {rs('c.c_acctbal / nullif(m1.med_ns, 0)')} AS bal_to_med_ns, {rs('c.c_acctbal / nullif(m2.med_s, 0)')} AS bal_to_med_s,
  {", ".join(f"coalesce(CAST(c.c_mktsegment = '{s}' AS INTEGER), 0) AS seg_{s.lower()}" for s in M.SEGMENTS)},
  CAST(c.c_mktsegment IS NULL AS INTEGER) AS seg_nan,
  {rs('CASE WHEN c.c_acctbal > -1 THEN ln(1 + c.c_acctbal) END')} AS log_bal,
  {_rowstats_sql(['c.c_acctbal / 1000.0', 'c.c_nationkey', 'length(c.c_name)'])}
FROM c LEFT JOIN m1 ON c.c_nationkey = m1.c_nationkey AND c.c_mktsegment = m1.c_mktsegment
       LEFT JOIN m2 ON c.c_mktsegment = m2.c_mktsegment
"""


@query("mart_base", D1_SQL)
def q_mart_base(spark, sf):
    """D1 applicant base mart (U1 P6-P11 C1-C14 E1 A20 W1 on the customer table)."""
    return M.mart_base(load(spark, sf, "customer"), load(spark, sf, "nation"))


def _d2_sql():
    flags = ("A", "N", "R")
    po = ", ".join([f"CAST(sum(CAST(l_returnflag = '{f}' AS INTEGER)) AS BIGINT) AS n_{f.lower()}" for f in flags]
                   + [f"avg(CAST(l_returnflag = '{f}' AS DOUBLE)) AS share_{f.lower()}" for f in flags])
    cols = []
    for f in ["n_lines", "n_r", "share_a", "share_n", "share_r"]:
        cols.append(f"{rs(f'avg({f})')} AS ext_{f}_mean")
        if f.startswith("n_"):
            cols.append(f"CAST(coalesce(sum({f}), 0) AS BIGINT) AS ext_{f}_sum")
        else:
            cols.append(f"{rs(f'coalesce(sum({f}), 0)')} AS ext_{f}_sum")
    for tag, cond in (("o", "o_orderstatus = 'O'"), ("f", "o_orderstatus = 'F'"),
                      ("rest", "(o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F'))")):
        for f in ("n_lines", "share_r"):
            x = f"CASE WHEN {cond} THEN {f} END"
            cols.append(f"{rs(f'avg({x})')} AS ext_{f}_mean_{tag}")
            if f == "n_lines":
                cols.append(f"CAST(coalesce(sum({x}), 0) AS BIGINT) AS ext_{f}_sum_{tag}")
            else:
                cols.append(f"{rs(f'coalesce(sum({x}), 0)')} AS ext_{f}_sum_{tag}")
    return f"""
WITH po AS (SELECT l_orderkey, count(*) AS n_lines, {po} FROM lineitem GROUP BY 1),
o AS (SELECT o.o_custkey AS c_custkey, o.o_orderstatus, po.* FROM orders o JOIN po ON o.o_orderkey = po.l_orderkey)
SELECT c_custkey, {", ".join(cols)} FROM o GROUP BY 1
"""


D2_SQL = _d2_sql()


@query("mart_external", D2_SQL)
def q_mart_external(spark, sf):
    """Lines -> orders -> customers with return-flag counts / shares and status blocks."""
    return M.mart_external(load(spark, sf, "orders"), load(spark, sf, "lineitem"))


D3_SQL = f"""
SELECT o_custkey AS c_custkey,
  {rs('min(o_totalprice)')} AS ord_price_min, {rs('avg(o_totalprice)')} AS ord_price_mean,
  {rs('max(o_totalprice)')} AS ord_price_max, {rs('var_samp(o_totalprice)')} AS ord_price_var,
  arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus IS NOT NULL) AS ord_status_last,
  count(*) AS ord_n_size,
  {", ".join(f"{rs(f'avg(CAST(o_orderstatus = {chr(39)}{s}{chr(39)} AS DOUBLE))')} AS share_status_{s.lower()}" for s in ("F", "O", "P"))},
  {", ".join(f"{rs(f'avg(CAST(o_orderpriority = {chr(39)}{p}{chr(39)} AS DOUBLE))')} AS share_prio_{p[0]}" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))},
  {rs("round_even(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 30.0, 0) / count(*)")} AS months_per_order
FROM orders GROUP BY 1
"""


@query("mart_orders", D3_SQL)
def q_mart_orders(spark, sf):
    """D3: prior-loan mart per customer (price stats, shares, last status, months per order)."""
    return M.mart_orders(load(spark, sf, "orders"))


def _d4_sql():
    cols = []
    ints = {"open_sum", "closed_sum", "ret_closed_max"}
    for c in ["qty_min", "qty_max", "open_sum", "closed_sum", "ret_closed_max"]:
        for fn in ("mean", "min", "max", "sum"):
            if fn == "mean":
                cols.append(f"{rs(f'avg({c})')} AS mon_{c}_{fn}")
            elif fn == "sum":
                cols.append(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS mon_{c}_{fn}" if c in ints
                            else f"{rs(f'coalesce(sum({c}), 0)')} AS mon_{c}_{fn}")
            else:
                cols.append(f"{fn}({c}) AS mon_{c}_{fn}" if c in ints else f"{rs(f'{fn}({c})')} AS mon_{c}_{fn}")
    return f"""
WITH li AS (SELECT l.*, o.o_custkey AS c_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
mid AS (SELECT c_custkey, l_orderkey, min(l_quantity) AS qty_min, max(l_quantity) AS qty_max,
               CAST(coalesce(sum(CAST(l_linestatus = 'O' AS INTEGER)), 0) AS BIGINT) AS open_sum,
               CAST(coalesce(sum(CAST(l_linestatus = 'F' AS INTEGER)), 0) AS BIGINT) AS closed_sum,
               max(CAST(coalesce(l_returnflag = 'R' AND l_linestatus = 'F', false) AS INTEGER)) AS ret_closed_max
        FROM li GROUP BY 1, 2)
SELECT c_custkey, {", ".join(cols)}, count(*) AS mon_n_l_orderkey FROM mid GROUP BY 1
"""


D4_SQL = _d4_sql()


@query("mart_monthly", D4_SQL)
def q_mart_monthly(spark, sf):
    """Lines -> order -> customer through the extended aggregate spec."""
    return M.mart_monthly(load(spark, sf, "orders"), load(spark, sf, "lineitem"))


_WL = "PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _d5_sql():
    cols = []
    for c in ["ratio_mean", "diff_sum", "late_n", "paid_total", "roll3_max", "paid_std"]:
        for fn in ("mean", "sum", "max"):
            if c == "late_n" and fn in ("sum", "max"):
                cols.append(f"CAST({'coalesce(sum(late_n), 0)' if fn == 'sum' else 'max(late_n)'} AS BIGINT) AS ins_{c}_{fn}")
            elif fn == "mean":
                cols.append(f"{rs(f'avg({c})')} AS ins_{c}_{fn}")
            elif fn == "sum":
                cols.append(f"{rs(f'coalesce(sum({c}), 0)')} AS ins_{c}_{fn}")
            else:
                cols.append(f"{rs(f'max({c})')} AS ins_{c}_{fn}")
    return f"""
WITH li AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                   l_extendedprice AS due, l_extendedprice * (1 - l_discount) AS paid FROM lineitem),
s AS (SELECT l_orderkey, paid / nullif(due, 0) AS ratio, paid,
        coalesce(due - lag(due) OVER ({_WL}), 0.0) AS due_diff,
        CASE WHEN paid IS NULL THEN 0.0 ELSE coalesce(sum(paid) OVER ({_WL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) END AS paid_run,
        CASE WHEN count(due) OVER ({_WL} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
             THEN avg(due) OVER ({_WL} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS due_roll3,
        CAST(coalesce(date_diff('day', CAST(lag(l_shipdate) OVER ({_WL}) AS DATE), CAST(l_shipdate AS DATE)) > 30, false) AS INTEGER) AS late
      FROM li),
po AS (SELECT l_orderkey, avg(ratio) AS ratio_mean, sum(due_diff) AS diff_sum, CAST(sum(late) AS BIGINT) AS late_n,
              max(paid_run) AS paid_total, max(due_roll3) AS roll3_max, stddev_samp(paid) AS paid_std FROM s GROUP BY 1),
o AS (SELECT o.o_custkey AS c_custkey, po.* FROM po JOIN orders o ON po.l_orderkey = o.o_orderkey)
SELECT c_custkey, {", ".join(cols)} FROM o GROUP BY 1
"""


D5_SQL = _d5_sql()


def _d5(spark, sf, chunk, adaptive=True):
    return M.mart_instalments(load(spark, sf, "orders"), load(spark, sf, "lineitem"), chunk_rows=chunk,
                              adaptive=adaptive)


@query("mart_instalments", D5_SQL)
def q_mart_instalments(spark, sf):
    """Instalment-style sequence features per order (chunked plan) -> customer."""
    return _d5(spark, sf, M.SEQ_CHUNK_ROWS)


@query("mart_instalments_small_chunks", D5_SQL)
def q_mart_instalments_small_chunks(spark, sf):
    """D5 forced onto the chunked plan with blocks of 4 lines, so every multi-line order spans
    several blocks."""
    return _d5(spark, sf, 4, adaptive=False)


D6_SQL = f"""
SELECT user_id AS c_custkey, {rs('avg(CAST(value < 50 AS DOUBLE)) * 100.0')} AS ser_pct_under_50,
  {rs("sum(CASE WHEN event_type = 'purchase' THEN value END) / nullif(sum(value), 0) * 100.0")} AS ser_purchase_share,
  {rs('max(CASE WHEN value > 400 THEN value END)')} AS ser_max_over_400,
  count(DISTINCT event_type) AS ser_n_types, CAST(sum(up) AS BIGINT) AS ser_n_up
FROM (SELECT *, CAST(coalesce(value > lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS INTEGER) AS up
      FROM events) GROUP BY 1
"""


@query("mart_series", D6_SQL)
def q_mart_series(spark, sf):
    """Event-series mart per user."""
    return M.mart_series(load(spark, sf, "events"))


def _d7_sql():
    days = "date_diff('day', DATE '2001-01-01', CAST(o_orderdate AS DATE))"
    slices = {"first_2": "rn <= 2", "last_5": "rn > cnt - 5", "all": "true", "last_year": f"{days} > -365",
              "status_f": "o_orderstatus = 'F'", "status_rest": "o_orderstatus IS DISTINCT FROM 'F'"}
    cols = []
    for tag, cond in slices.items():
        x = f"CASE WHEN {cond} THEN o_totalprice END"
        cols += [f"{rs(f'coalesce(sum({x}), 0)')} AS sl_sum_{tag}", f"{rs(f'avg({x})')} AS sl_mean_{tag}",
                 f"{rs(f'max({x})')} AS sl_max_{tag}"]
    return f"""
WITH o AS (SELECT o_custkey AS c_custkey, o_totalprice, o_orderstatus, o_orderdate,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rd,
                  count(*) OVER (PARTITION BY o_custkey) AS cnt FROM orders),
e AS (SELECT c_custkey, sum(pow({_BETA}, rd - 1) * o_totalprice) / sum(pow({_BETA}, rd - 1)) AS ewm
      FROM o GROUP BY 1),
g AS (SELECT c_custkey, {", ".join(cols)} FROM o GROUP BY 1)
SELECT g.*, {rs('e.ewm')} AS sl_ewm_last FROM g JOIN e USING (c_custkey)
"""


D7_SQL = _d7_sql()


@query("mart_slices", D7_SQL)
def q_mart_slices(spark, sf):
    """First-k / last-k / last-year / by-status slices and EWM at the latest order."""
    return M.mart_slices(load(spark, sf, "orders"))


D8_SQL = f"""SELECT c_custkey, cluster_size AS nb_cluster_size, prev_label AS nb_prev_label, next_label AS nb_next_label
FROM ({LOOKALIKE_SQL})"""


@query("mart_neighbours", D8_SQL)
def q_mart_neighbours(spark, sf):
    """Look-alike neighbour labels per customer."""
    return M.mart_neighbours(load(spark, sf, "customer"))


MART_FINAL_SQL = f"""
WITH d1 AS ({D1_SQL}), d2 AS ({D2_SQL}), d3 AS ({D3_SQL}), d4 AS ({D4_SQL}), d5 AS ({D5_SQL}),
d6 AS ({D6_SQL}), d7 AS ({D7_SQL}), d8 AS ({D8_SQL})
SELECT * FROM d1 LEFT JOIN d2 USING (c_custkey) LEFT JOIN d3 USING (c_custkey) LEFT JOIN d4 USING (c_custkey)
  LEFT JOIN d5 USING (c_custkey) LEFT JOIN d6 USING (c_custkey) LEFT JOIN d7 USING (c_custkey)
  LEFT JOIN d8 USING (c_custkey)
"""


def _final(spark, sf):
    return M.final_marts(load(spark, sf, "customer"), load(spark, sf, "nation"), load(spark, sf, "orders"),
                         load(spark, sf, "lineitem"), load(spark, sf, "events"))


@query("mart_final", MART_FINAL_SQL)
def q_mart_final(spark, sf):
    """One row per customer, star join of D1-D8 (the deterministic marts)."""
    return _final(spark, sf)


def _binned_inputs(spark, sf):
    o, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    # every seventh customer has no label, so that the unlabelled path runs; two string columns stay in
    c = load(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"]).select(
        "c_custkey", F.when(F.col("c_custkey") % 7 != 0, (F.col("c_acctbal") < 0).cast("int")).alias("y"), "c_mktsegment")
    d3 = M.mart_orders(o)
    d5 = M.mart_instalments(o, li)
    return c.join(d3, "c_custkey", "left").join(d5, "c_custkey", "left")


for _keep in ("both", "binned", "numeric_binned", "originals_passing"):
    def _mk(keep):
        def q(spark, sf):
            return M.binned_mart(_binned_inputs(spark, sf), "y", keep=keep)
        q.__doc__ = f"D10 binned mart (keep={keep!r}): constants out, bins on labelled rows, WoE, IV >= 0.02."
        return q
    query("binned_mart" if _keep == "both" else f"binned_mart_{_keep}")(_mk(_keep))


# Which columns a binned mart has depends on the data, so the checked form is long: a row per customer and column. Both sides bin
# the inputs rounded as for comparison, in 10 pre-bins, as the SQL lists every way to cut them.
_D10_INTS = ["ord_n_size", "ins_late_n_sum", "ins_late_n_max"]
_D10_NUMS = (["ord_price_min", "ord_price_mean", "ord_price_max", "ord_price_var", "ord_n_size", "share_status_f", "share_status_o", "share_status_p",
              *[f"share_prio_{i}" for i in range(1, 6)], "months_per_order"]
             + [f"ins_{c}_{fn}" for c in ("ratio_mean", "diff_sum", "late_n", "paid_total", "roll3_max", "paid_std") for fn in ("mean", "sum", "max")])
_D10_CATS = ["c_mktsegment", "ord_status_last"]


def _varied(src, cols):
    """SQL: names of the columns that take two values at least among labelled rows."""
    return " UNION ALL ".join(f"SELECT '{c}' AS feature WHERE (SELECT min({c}) < max({c}) FROM {src} WHERE y IS NOT NULL)" for c in cols)


def _d10_sql(keep):
    nums, cats = _D10_NUMS, [] if keep == "numeric_binned" else _D10_CATS
    means = ", ".join(f"coalesce({c}, (SELECT {'trunc(avg(' + c + '))' if c in _D10_INTS else 'avg(' + c + ')'} FROM m WHERE y IS NOT NULL)) AS {c}" for c in nums)
    fill = f"imp AS (SELECT c_custkey, y, {means} FROM m),\n{BS.bins_ctes('imp', nums, [], 'c_custkey', 10, 0.05, '_i')}," if keep in ("both", "numeric_binned") else ""
    none = "CAST(NULL AS VARCHAR)"
    binned = f"SELECT c_custkey, y, feature || '_binned' AS feature, {rs('woe')} AS value, {none} AS text FROM ({BS.woe_of_rows('', 'c_custkey', 0.05)}) JOIN passing USING (feature)"
    if keep in ("both", "numeric_binned"):
        out = f"""{binned} UNION ALL SELECT c_custkey, y, feature, {rs('x')}, {none} FROM nl_i
JOIN (SELECT feature FROM bins_i JOIN varied USING (feature) GROUP BY 1 HAVING sum(iv) >= 0.02) USING (feature)"""
    elif keep == "binned":
        out = binned
    else:
        out = f"""SELECT c_custkey, y, feature, {rs('x')} AS value, {none} AS text FROM nl JOIN passing USING (feature)
UNION ALL SELECT c_custkey, y, feature, CAST(NULL AS DOUBLE), v FROM tl JOIN passing USING (feature)"""
    return f"""WITH RECURSIVE c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_acctbal < 0 AS INTEGER) END AS y, c_mktsegment FROM customer),
m AS (SELECT * FROM c LEFT JOIN ({D3_SQL}) USING (c_custkey) LEFT JOIN ({D5_SQL}) USING (c_custkey)),
varied AS ({_varied('m', nums + cats)}),
{BS.bins_ctes('m', nums, cats, 'c_custkey', 10, 0.05)},
{fill}
passing AS (SELECT feature FROM bins JOIN varied USING (feature) GROUP BY 1 HAVING sum(iv) >= 0.02)
{out}"""


for _keep in ("both", "binned", "numeric_binned", "originals_passing"):
    def _mk_check(keep):
        def q(spark, sf):
            d = M.binned_mart(normalize(_binned_inputs(spark, sf)), "y", keep=keep, prebins=10)
            kinds = dict(d.dtypes)
            cells = [F.struct(F.lit(c).alias("feature"), (F.lit(None) if kinds[c] == "string" else F.col(c)).cast("double").alias("value"),
                              (F.col(c) if kinds[c] == "string" else F.lit(None)).cast("string").alias("text")) for c in d.columns if c not in ("c_custkey", "y")]
            if not cells:                        # no column passes
                return d.where("false").select("c_custkey", "y", F.lit("").alias("feature"), F.lit(0.0).alias("value"), F.lit("").alias("text"))
            return d.select("c_custkey", "y", F.explode(F.array(*cells)).alias("x")).select("c_custkey", "y", "x.feature", "x.value", "x.text")
        q.__doc__ = f"D10 binned mart (keep={keep!r}) in long form, over 10 pre-bins."
        return q
    query(f"binned_mart_{_keep}_long", _d10_sql(_keep))(_mk_check(_keep))


@query("mart_final_full")
def q_mart_final_full(spark, sf):
    """D11 with the model marts: D1-D8 plus nested-model statistics (D9) and binned columns
    (D10); one row per customer."""
    from featmart.plans.catalog_model import nested_mart
    nested = nested_mart(spark, sf).withColumnRenamed("o_custkey", "c_custkey")
    binned = M.binned_mart(_binned_inputs(spark, sf), "y", keep="binned").drop("y")
    return M.mart_final([nested, binned], _final(spark, sf))
