"""Feature marts on the star schema.

Stand-ins: applicant = customer, loan = orders, detail rows = lineitem, time series = events.
Every mart is one lazy plan keyed by the entity; aggregation happens before any join so joins
never multiply detail rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.functions.nulls import flag, safe_div
from featmart.operators.agg import AggSpec, aggregate

LATE_DAYS = 60


def order_lines(lineitem: DataFrame) -> DataFrame:
    """lineitem -> one row per order (aggregate before the join to orders)."""
    spec = AggSpec([
        ("price", ["size", "sum", "mean", "min", "max"], "l_extendedprice"),
        ("returned", ["mean"], "CAST(l_returnflag = 'R' AS INT)"),
        ("discount", ["mean"], "l_discount"),
        ("ship", ["max"], "l_shipdate"),
    ])
    return aggregate(lineitem, "l_orderkey", spec, prefix="line_")


def customer_mart(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Flagship (A1, A6, J1, C1): lines -> orders -> customers, then ratios.

    Plan: partial+final aggregate of lineitem by order key; join to orders on the order key
    (the aggregated side is already hash-partitioned by it); derive order-level columns; second
    aggregate by customer; left join onto customers (all customers kept)."""
    per_order = order_lines(lineitem)
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    loans = (o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
             .select(
                 "o_orderkey", "o_custkey", "o_totalprice",
                 F.coalesce(F.col("line_price_size"), F.lit(0)).alias("n_lines"),
                 F.col("line_price_sum").alias("line_sum"),
                 F.col("line_price_mean").alias("line_mean"),
                 F.col("line_price_max").alias("line_max"),
                 F.col("line_returned_mean").alias("returned_share"),
                 F.col("line_discount_mean").alias("discount_mean"),
                 flag(F.datediff(F.col("line_ship_max"), F.col("o_orderdate")) > LATE_DAYS).alias("late"),
                 safe_div("line_price_sum", "o_totalprice").alias("lines_to_total"),
             ))
    top = AggSpec().extend_from(["o_totalprice", "n_lines", "line_sum", "line_mean", "line_max",
                                 "returned_share", "discount_mean", "late", "lines_to_total"])
    per_cust = aggregate(loans, "o_custkey", top, prefix="ord_",
                         extra=[F.count(F.lit(1)).alias("ord_count")])
    c = customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    out = (c.join(per_cust, c.c_custkey == per_cust.o_custkey, "left").drop("o_custkey")
           .withColumn("bal_to_spend", safe_div("c_acctbal", "ord_o_totalprice_sum"))
           .withColumn("late_share", safe_div("ord_late_sum", "ord_count")))
    return out


# =====================================================================================
# D1-D11.  Every mart returns one row per customer key ``c_custkey`` (D2-D7 only for customers
# with child rows; the final mart left-joins them onto all customers).
# =====================================================================================

import featmart.operators.agg as A  # noqa: E402
from featmart.functions import exprs as X  # noqa: E402
from featmart.functions.nulls import half_even, log1p_guarded, ne_null_safe  # noqa: E402
from featmart.operators import clean as CL  # noqa: E402
from featmart.operators import encode as EN  # noqa: E402
from featmart.operators import joins as J  # noqa: E402
from featmart.operators import quantile as Q  # noqa: E402
from featmart.operators import seq as S  # noqa: E402

# Sequence features in the marts use the skew-safe chunked plan: an entity of any size is cut
# into blocks of this many rows.
SEQ_CHUNK_ROWS = 1_000_000
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
ORDER_ORDER = ["o_orderdate", "o_orderkey"]
REF_DATE = "2001-01-01"


def mart_base(customer: DataFrame, nation: DataFrame, largest: int | None = None, rows: DataFrame | None = None, extra: Sequence[str] = (),
              groups: int | None = None) -> DataFrame:
    """Customer + nation name; balance relative to the median of its (nation, segment) and
    of its segment (attached via aggregate + join); segment one-hot with a missing column;
    guarded log1p; row statistics. ``rows``: the customers with the further columns ``extra``, to be kept; ``groups``: no
    fewer than the (nation, segment) groups and segments, if that is known."""
    from featmart.session import cut_lineage
    c = (customer if rows is None else rows).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", *extra)
    # both medians by one ranking: a row counts for its (nation, segment) and for its segment
    none = F.lit(None).cast(c.schema["c_nationkey"].dataType)
    sets = F.array(F.struct(F.lit(0).alias("s"), F.col("c_nationkey").alias("n")), F.struct(F.lit(1).alias("s"), none.alias("n")))
    both = customer.select("c_mktsegment", "c_acctbal", F.explode(sets).alias("g")).select("g.s", "g.n", "c_mktsegment", "c_acctbal")
    m = cut_lineage(Q.percentiles(both, ["s", "n", "c_mktsegment"], "c_acctbal", [0.5], names=["med"], largest=largest))
    few = J.few_rows(m) if groups is None else F.broadcast(m) if groups <= 50_000 else m          # a row per nation and segment
    ns = few.where("s = 0").select(F.col("n").alias("c_nationkey"), "c_mktsegment", F.col("med").alias("med_ns"))
    s = few.where("s = 1").select("c_mktsegment", F.col("med").alias("med_s"))
    c = c.join(ns, ["c_nationkey", "c_mktsegment"], "left").join(s, ["c_mktsegment"], "left")
    c = c.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    c, _ = EN.one_hot_apply(c, {"c_mktsegment": SEGMENTS}, dummy_na=True, drop_source=False)
    parts = [F.col("c_acctbal") / 1000.0, F.col("c_nationkey"), F.length("c_name")]
    return c.select(
        "c_custkey", "n_name", "c_mktsegment",
        safe_div("c_acctbal", "med_ns").alias("bal_to_med_ns"), safe_div("c_acctbal", "med_s").alias("bal_to_med_s"),
        *[F.col(f"c_mktsegment_{s}").alias(f"seg_{s.lower()}") for s in SEGMENTS],
        F.col("c_mktsegment_nan").alias("seg_nan"),
        log1p_guarded("c_acctbal").alias("log_bal"),
        X.row_mean(parts).alias("row_mean"), X.row_max(parts).alias("row_max"), X.row_std(parts).alias("row_std"), *extra)


# ---------------------------------------------------------------------------- per-order stage
# D2, D4 and D5 all aggregate line items per order.  ``order_level`` computes every order-level
# column they need in ONE pass over lineitem (one shuffle by order key: the sequence window and
# the per-order aggregate share it), and ``order_customer_exprs`` gives their customer-level
# aggregates as expressions for ONE group-by.

_D2_FLAGS = ("A", "N", "R")
_D2_FEATS = ["n_lines", "n_r", "share_a", "share_n", "share_r"]
_D4_FEATS = ["qty_min", "qty_max", "open_sum", "closed_sum", "ret_closed_max"]
_D5_FEATS = ["ratio_mean", "diff_sum", "late_n", "paid_total", "roll3_max", "paid_std"]
_D5_SEQ = {"due_diff": ("diff", "due", 0.0), "paid_run": ("running_sum", "paid"),
           "due_roll3": ("rolling_mean", "due", 3), "prev_ship": ("lag", "l_shipdate", 1)}


def order_level(orders: DataFrame, lineitem: DataFrame, parts: Sequence[str] = ("external", "monthly", "instalments"),
                chunk_rows: int | None = SEQ_CHUNK_ROWS, adaptive: bool = True, largest: int | None = None) -> DataFrame:
    """One row per order (with its customer and status) holding the order-level columns of the
    requested marts: 'external' (D2: line count, return-flag counts and shares), 'monthly' (D4:
    quantity range, counts per line status, returned-and-closed flag), 'instalments' (D5: lines
    in ship order - paid ratio, due difference, late flag, running paid, rolling 3 mean of due)."""
    # the price goes by one name, 'due': a second copy would be shuffled and sorted as well
    li = lineitem.select("l_orderkey", *[c for c in LINE_ORDER if c != "l_extendedprice"], "l_quantity",
                         "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("due"),
                         (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))
    aggs = []
    if "external" in parts:
        aggs += [F.count(F.lit(1)).alias("n_lines"),
                 *[F.sum((F.col("l_returnflag") == f).cast("long")).alias(f"n_{f.lower()}") for f in _D2_FLAGS],
                 *[F.avg((F.col("l_returnflag") == f).cast("double")).alias(f"share_{f.lower()}") for f in _D2_FLAGS]]
    if "monthly" in parts:
        aggs += A.AggSpec([("qty", ["min", "max"], "l_quantity"),
                           ("open", ["sum"], "CAST(l_linestatus = 'O' AS INT)"),
                           ("closed", ["sum"], "CAST(l_linestatus = 'F' AS INT)"),
                           ("ret_closed", ["max"],
                            "CAST(coalesce(l_returnflag = 'R' AND l_linestatus = 'F', false) AS INT)")]).columns()
    if "instalments" in parts:
        li = S.sequence_features(li, "l_orderkey", ["due" if c == "l_extendedprice" else c for c in LINE_ORDER], _D5_SEQ, chunk_rows=chunk_rows, adaptive=adaptive, largest=largest)
        li = li.withColumn("ratio", safe_div("paid", "due")).withColumn(
            "late", flag(F.datediff("l_shipdate", "prev_ship") > 30))
        aggs += [F.avg("ratio").alias("ratio_mean"), F.sum("due_diff").alias("diff_sum"),
                 F.sum("late").alias("late_n"), F.max("paid_run").alias("paid_total"),
                 F.max("due_roll3").alias("roll3_max"), F.stddev_samp("paid").alias("paid_std")]
    per_o = li.groupBy("l_orderkey").agg(*aggs)
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"),
                      "o_orderstatus")
    return per_o.join(o, "l_orderkey")


def order_customer_exprs(parts: Sequence[str] = ("external", "monthly", "instalments")) -> list[Column]:
    """Customer-level aggregate expressions over ``order_level`` rows for the requested marts."""
    exprs: list[Column] = []
    if "external" in parts:
        exprs += A.AggSpec([(f, ["mean", "sum"], f) for f in _D2_FEATS]).columns("ext_")
        exprs += A.cond_agg_exprs("o_orderstatus", ["O", "F"],
                                  A.AggSpec([(f"ext_{f}", ["mean", "sum"], f) for f in ("n_lines", "share_r")]))
    if "monthly" in parts:
        exprs += A.AggSpec().extend_from(_D4_FEATS).columns("mon_")
        exprs.append(F.count(F.lit(1)).alias("mon_n_l_orderkey"))
    if "instalments" in parts:
        exprs += A.AggSpec().extend_from(_D5_FEATS, ("mean", "sum", "max")).columns("ins_")
    return exprs


def orders_marts(orders: DataFrame, lineitem: DataFrame, parts: Sequence[str] = ("external", "monthly", "instalments"),
                 chunk_rows: int | None = SEQ_CHUNK_ROWS, adaptive: bool = True, largest: int | None = None) -> DataFrame:
    """D2 + D4 + D5 (any subset) per customer: one lineitem pass, one customer group-by."""
    per_o = order_level(orders, lineitem, parts, chunk_rows, adaptive, largest).filter(F.col("c_custkey").isNotNull())
    return per_o.groupBy("c_custkey").agg(*order_customer_exprs(parts))


def mart_external(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Lines per order (count, sum and share per return flag) -> customer mean / sum, with
    separate blocks for order status O, F and the null-safe rest - all conditional aggregates."""
    return orders_marts(orders, lineitem, ("external",))


def mart_monthly(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Lines -> order (min/max quantity, counts per line status, conjunctive flag) -> customer
    with mean/min/max/sum of every order-level column through the extended spec (A6)."""
    return orders_marts(orders, lineitem, ("monthly",))


def mart_instalments(orders: DataFrame, lineitem: DataFrame, chunk_rows: int | None = SEQ_CHUNK_ROWS,
                     adaptive: bool = True) -> DataFrame:
    """Lines in ship order per order: due = price, paid = price (1 - discount); paid ratio,
    due difference to the previous line, late flag (> 30 days after the previous shipment),
    running paid, rolling 3 mean of due -> order (mean/max/sum/std) -> customer (mean/sum/max)."""
    return orders_marts(orders, lineitem, ("instalments",), chunk_rows, adaptive)


# ---------------------------------------------------------------------------- orders stage

def _d3_spec() -> A.AggSpec:
    return A.AggSpec([("price", ["min", "mean", "max", "var"], "o_totalprice"),
                      ("status", ["last"], "o_orderstatus"),
                      ("date", ["min", "max"], "o_orderdate"), ("n", ["size"], "1")], order=ORDER_ORDER)


def _d3_exprs() -> list[Column]:
    shares = [F.avg((F.col("o_orderstatus") == s).cast("double")).alias(f"share_status_{s.lower()}")
              for s in ("F", "O", "P")]
    shares += [F.avg((F.col("o_orderpriority") == p).cast("double")).alias(f"share_prio_{p[0]}")
               for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
    return _d3_spec().columns("ord_") + shares


def _d3_finish(g: DataFrame) -> DataFrame:
    months = half_even(F.datediff("ord_date_max", "ord_date_min") / F.lit(30.0))
    return g.withColumn("months_per_order", safe_div(months, "ord_n_size")).drop("ord_date_min", "ord_date_max")


def mart_orders(orders: DataFrame) -> DataFrame:
    """D3: price min/mean/max/var, share per status and priority, last status by date, months
    between first and last order per order (half-even months of 30 days)."""
    g = orders.withColumnRenamed("o_custkey", "c_custkey").filter(F.col("c_custkey").isNotNull()) \
        .groupBy("c_custkey").agg(*_d3_exprs())
    return _d3_finish(g)


def mart_series(events: DataFrame, chunk_rows: int | None = SEQ_CHUNK_ROWS, largest: int | None = None) -> DataFrame:
    """Per user: % events under a value limit, ratio of sums for one event type, max over a
    limit, distinct types, count of increases along time."""
    e = events.select("event_id", F.col("user_id").alias("c_custkey"), "ts", "event_type", "value")
    s = S.sequence_features(e, "c_custkey", ["ts", "event_id"], {"up": ("increase", "value")}, chunk_rows=chunk_rows, largest=largest)
    return s.groupBy("c_custkey").agg(
        (F.avg(flag(F.col("value") < 50)) * 100.0).alias("ser_pct_under_50"),
        (safe_div(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.sum("value")) * 100.0)
        .alias("ser_purchase_share"),
        F.max(F.when(F.col("value") > 400, F.col("value"))).alias("ser_max_over_400"),
        F.countDistinct("event_type").alias("ser_n_types"),
        F.sum("up").alias("ser_n_up"))


def _slices_input(orders: DataFrame, chunk_rows: int | None, alpha: float, largest: int | None = None) -> DataFrame:
    o = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice",
                      "o_orderstatus", "o_orderpriority").filter(F.col("c_custkey").isNotNull())
    return S.sequence_features(o, "c_custkey", ORDER_ORDER,
                               {"rn": ("row_number",), "_cnt": ("key_count",), "ewm": ("ewm", "o_totalprice", alpha)},
                               chunk_rows=chunk_rows, largest=largest)


def _slices_exprs() -> list[Column]:
    days = F.datediff("o_orderdate", F.lit(REF_DATE).cast("date"))
    slices = {"first_2": F.col("rn") <= 2, "last_5": F.col("rn") > F.col("_cnt") - 5, "all": F.lit(True),
              "last_year": days > -365, "status_f": F.col("o_orderstatus") == "F",
              "status_rest": ne_null_safe("o_orderstatus", "F")}
    exprs = []
    for tag, cond in slices.items():
        x = F.when(cond, F.col("o_totalprice"))
        exprs += [A.agg_fn("sum", x).alias(f"sl_sum_{tag}"), F.avg(x).alias(f"sl_mean_{tag}"),
                  F.max(x).alias(f"sl_max_{tag}")]
    exprs.append(A.last_nonnull("ewm", ORDER_ORDER).alias("sl_ewm_last"))
    return exprs


def mart_slices(orders: DataFrame, chunk_rows: int | None = SEQ_CHUNK_ROWS, alpha: float = 0.7) -> DataFrame:
    """First 2 / last 5 / all orders; last 365 days; by status (null-safe rest); EWM of the
    price at the customer's latest order."""
    return _slices_input(orders, chunk_rows, alpha).groupBy("c_custkey").agg(*_slices_exprs())


def orders_slices_marts(orders: DataFrame, chunk_rows: int | None = SEQ_CHUNK_ROWS, alpha: float = 0.7, largest: int | None = None) -> DataFrame:
    """D3 + D7 per customer from one orders window (partitioned by customer) and one group-by on
    the same key (no second exchange)."""
    g = _slices_input(orders, chunk_rows, alpha, largest).groupBy("c_custkey").agg(*_d3_exprs(), *_slices_exprs())
    return _d3_finish(g)


_ALIKE = ["c_nationkey", "c_mktsegment", "bal_bucket"]


def _bucketed(customer: DataFrame) -> DataFrame:
    return customer.withColumns({"bal_bucket": F.floor(F.abs("c_acctbal") / 2500), "label": (F.col("c_acctbal") < 0).cast("int")})


def with_neighbours(customer: DataFrame, counts: DataFrame | None = None, n_clusters: int | None = None, largest: int | None = None) -> DataFrame:
    """The customers with their cluster's size and the previous / next label in it."""
    cl = S.lookalike_clusters(_bucketed(customer), _ALIKE, "c_custkey", counts, n_clusters)
    # a group of copies can hold a large share of all rows: chunked plan
    nb = S.neighbour_labels(cl, "cluster", ["c_acctbal", "c_custkey"], "label", chunk_rows=SEQ_CHUNK_ROWS, largest=largest)
    return nb.select(*customer.columns, F.col("cluster_size").alias("nb_cluster_size"),
                     F.col("prev_label").alias("nb_prev_label"), F.col("next_label").alias("nb_next_label"))


_NB = ["nb_cluster_size", "nb_prev_label", "nb_next_label"]


def mart_neighbours(customer: DataFrame) -> DataFrame:  # noqa: D401
    """Customers alike on (nation, segment, balance bucket): previous / next label."""
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return with_neighbours(c).select("c_custkey", *_NB)


def final_marts(customer: DataFrame, nation: DataFrame, orders: DataFrame, lineitem: DataFrame,
                events: DataFrame) -> DataFrame:
    """D11 over D1-D8 with shared stages: one lineitem plan serves D2 + D4 + D5, one orders window
    D3 + D7, one events window D6, one customer window D8 below D1; everything is then keyed by the customer and
    star-joined onto the base mart (D1).

    Before the plan runs there are three steps: the customers counted by what makes them alike; one count that finds
    the largest key of every window of the plan; the medians of D1."""
    from featmart.session import cut_lineage
    c = customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    alike = cut_lineage(_bucketed(c).groupBy(*_ALIKE).agg(F.count(F.lit(1)).alias("_n")))
    n = F.col("_n")
    group = F.concat_ws("|", "c_mktsegment", "bal_bucket", F.col("c_mktsegment").isNull().cast("string"))
    top = S.largest_keys({
        "lines": (lineitem, ("l_orderkey", None), None), "orders": (orders, ("o_custkey", None), None), "events": (events, ("user_id", None), None),
        "segment": (alike, (None, "c_mktsegment"), n), "cluster": (alike, ("c_nationkey", group), n), "clusters": (alike.where("_n > 1"), (None, None), None),
        "alike": (alike, (None, None), None)}, hashed=("lines", "events"))
    base = mart_base(c, nation, top.get("segment", 0), with_neighbours(c, alike, top.get("clusters", 0), top.get("cluster", 0)), _NB, 2 * top.get("alike", 0))
    marts = [orders_marts(orders, lineitem, largest=top.get("lines", 0)), orders_slices_marts(orders, largest=top.get("orders", 0)),
             mart_series(events, largest=top.get("events", 0))]
    return mart_final(marts, base)


def mart_final(marts: list[DataFrame], base: DataFrame) -> DataFrame:
    """Star join of the per-customer marts onto the base mart; one row per customer.

    Every mart is the output of an aggregation keyed by ``c_custkey`` and therefore already
    hash-partitioned by it; the left joins reuse that partitioning."""
    return J.star_join(base, "c_custkey", marts)


def binned_mart(features: DataFrame, label: str, keep: str = "both", iv_min: float = 0.02, min_share: float = 0.05,
                missing_value: float = 0.05, prebins: int = 30) -> DataFrame:
    """Constants out (Q6); bins of numeric and categorical columns fitted on the labelled rows (E8);
    WoE columns with a fixed value for missing (E9); then imputation with statistics of the labelled
    part; then the IV selection (Q7). The unlabelled part is transformed with the same parameters.

    keep: 'both' -> numeric originals (mean-imputed) and binned columns, each kept if its own IV passes;
          'binned' -> binned columns that pass; 'numeric_binned' -> as 'both', over numeric columns only;
          'originals_passing' -> original values of the columns whose binned version passes."""
    from featmart.operators import select as SE
    from featmart.session import cut_lineage
    if keep not in ("both", "binned", "numeric_binned", "originals_passing"):
        raise ValueError(keep)
    feats = [c for c in features.columns if c not in ("c_custkey", label)]
    data = cut_lineage(features)          # read by the constants, the bins and the output
    lab = data.filter(F.col(label).isNotNull())
    varied = [r["feature"] for r in SE.constant_columns(lab, feats).filter("keep").collect()]      # a row per column
    kinds = dict(data.dtypes)
    nums = [c for c in feats if c in varied and kinds[c] in ("double", "int", "bigint", "float")]
    cats = [c for c in feats if c in varied and kinds[c] == "string"] if keep != "numeric_binned" else []
    bins = EN.optimal_bins(lab, label, nums, cats, prebins, min_share, written=True)
    iv = {r["feature"]: r["iv"] for r in bins.table.groupBy("feature").agg(F.sum("iv").alias("iv")).collect()}
    binned = EN.binned_apply(data.select("c_custkey", label, *nums, *cats), bins, missing_value=missing_value)
    passing = [c for c in [*nums, *cats] if iv.get(c, 0.0) >= iv_min]
    if keep == "originals_passing":
        return binned.select("c_custkey", label, *passing)
    out = [f"{c}_binned" for c in passing]
    if keep != "binned":
        # the originals are imputed with the labelled part's means, and selected by the IV that the
        # imputed column has
        imputed = CL.fill_statistic(binned, nums, "mean", fit_on=F.col(label).isNotNull())
        own = EN.optimal_bins(imputed.filter(F.col(label).isNotNull()), label, nums, (), prebins, min_share)
        own_iv = {r["feature"]: r["iv"] for r in own.table.groupBy("feature").agg(F.sum("iv").alias("iv")).collect()}
        out = [c for c in nums if own_iv.get(c, 0.0) >= iv_min] + out
        binned = imputed
    return binned.select("c_custkey", label, *out)
