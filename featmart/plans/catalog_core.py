"""Catalogue: scans/sinks, cleaning, scalar functions."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from featmart.functions import exprs as X
from featmart.functions import nulls as N
from featmart.operators import clean as CL
from featmart.operators.agg import AggSpec
from featmart.operators.joins import union_named
from featmart.plans.compare import rs
from featmart.plans.registry import query
from featmart.session import checkpoint_dir
from featmart.sources import (
    SCHEMAS, limit_rows, load, load_json, load_vectors, read_csv, read_csv_checked, save_json, save_vectors, split_by_label, write_scores, write_table,
)

INF = float("inf")


# ------------------------------------------------------------------ S9 J10
@query("label_split", f"""
SELECT CASE WHEN l.toxic IS NULL THEN 'unlabelled' ELSE 'labelled' END AS part,
       count(*) AS n_docs, {rs('avg(d.n_chars)')} AS mean_chars,
       {rs('avg(l.toxic)')} AS toxic_rate, {rs('avg(l.quality)')} AS quality_rate
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
GROUP BY 1
""")
def q_label_split(spark, sf):
    """Label attach (documents keep all rows) and split by label nullness."""
    docs = load(spark, sf, "documents", ["doc_id", "n_chars"])
    labels = load(spark, sf, "labels", ["doc_id", "toxic", "quality"])
    full = docs.join(labels, "doc_id", "left")
    lab, unl = split_by_label(full, "toxic")
    parts = union_named([lab.withColumn("part", F.lit("labelled")),
                         unl.withColumn("part", F.lit("unlabelled"))])
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_chars").alias("mean_chars"),
                                     F.avg("toxic").alias("toxic_rate"), F.avg("quality").alias("quality_rate"))


# ------------------------------------------------------------------ S3
@query("limited_scan", "SELECT least(count(*), 500) AS n, CAST(least(count(DISTINCT o_orderkey), 500) AS BIGINT) AS n_ids FROM orders")
def q_limited_scan(spark, sf):
    """Row-limited scan: at most 500 rows, each a row of the table (S3)."""
    o = load(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    head = limit_rows(o, 500).join(o.select("o_orderkey").distinct(), "o_orderkey")
    return head.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_ids"))


# ------------------------------------------------------------------ S6 S7
@query("spec_and_vector_handoff", f"""
SELECT o_orderstatus AS status, CAST(o_custkey % 3 AS INTEGER) AS fold, count(*) AS n, {rs('sum(o_totalprice)')} AS price_sum, {rs('max(o_totalprice)')} AS price_max
FROM orders GROUP BY 1, 2
""")
def q_spec_and_vector_handoff(spark, sf):
    """An aggregate spec as JSON and id / fold vectors as Parquet in the shared folder, read back by the
    next step and used (S6, S7)."""
    base = os.path.join(checkpoint_dir(spark), "featmart-io", uuid.uuid4().hex)
    o = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    save_json(spark, {"spec": AggSpec([("price", ["sum", "max"], "o_totalprice")]).to_json()}, f"{base}/spec")
    save_vectors(o.withColumn("fold", (F.col("o_custkey") % 3).cast("int")), f"{base}/folds", ["o_orderkey", "fold"])
    spec = AggSpec.from_json(load_json(spark, f"{base}/spec")["spec"])
    d = o.join(load_vectors(spark, f"{base}/folds"), "o_orderkey")
    return d.groupBy(F.col("o_orderstatus").alias("status"), "fold").agg(F.count(F.lit(1)).alias("n"), *spec.columns())


# ------------------------------------------------------------------ S1-S8
@query("scan_sink_roundtrip", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, {rs('o_totalprice')} AS o_totalprice, o_orderdate,
       CAST(o_orderkey AS INTEGER) AS score_id, {rs('o_totalprice / 1000000.0')} AS score
FROM orders
""")
def q_scan_sink_roundtrip(spark, sf):
    """Write orders as CSV and Parquet into the shared checkpoint area, read back with an
    explicit schema and column pruning; scored-file sink with int32 ids (S1-S8)."""
    base = os.path.join(checkpoint_dir(spark), "featmart-io", uuid.uuid4().hex)
    orders = load(spark, sf, "orders")
    write_table(orders, f"{base}/csv", fmt="csv")
    write_table(orders, f"{base}/parquet")
    back_csv = read_csv(spark, f"{base}/csv", schema=SCHEMAS["orders"]).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    back_pq = spark.read.parquet(f"{base}/parquet").select("o_orderkey", "o_totalprice")
    write_scores(back_pq.withColumn("score", F.col("o_totalprice") / F.lit(1e6)), "o_orderkey", "score",
                 f"{base}/scores")
    scores = read_csv(spark, f"{base}/scores", schema="o_orderkey INT, score DOUBLE").toDF("score_id", "score")
    return back_csv.join(scores, back_csv.o_orderkey == scores.score_id.cast("bigint"), "inner")


@query("csv_quarantine", f"""
WITH c AS (SELECT *, CASE WHEN c_custkey % 60 = 7 THEN 'not 5 fields' WHEN c_custkey % 50 = 0 THEN 'c_acctbal: not double' END AS reason FROM customer)
SELECT c_custkey, CASE WHEN reason IS NULL THEN c_name END AS c_name, CASE WHEN reason IS NULL THEN {rs('c_acctbal')} END AS c_acctbal,
  CASE WHEN reason IS NULL THEN CAST(c_nationkey AS INTEGER) END AS c_nationkey, reason, true AS types_right FROM c
""")
def q_csv_quarantine(spark, sf):
    """A CSV of all customers with a stray index column, rows that lack a field and values that are no numbers: types
    inferred, good rows typed, bad ones in a quarantine table with file and reason (S1, S4)."""
    base = os.path.join(checkpoint_dir(spark), "featmart-io", uuid.uuid4().hex)
    c = load(spark, sf, "customer", ["c_custkey", "c_name", "c_acctbal", "c_nationkey"])
    index, name = F.monotonically_increasing_id().cast("string"), F.col("c_name")
    bal = F.when(F.col("c_custkey") % 50 == 0, "abc").otherwise(F.col("c_acctbal").cast("string"))
    last = F.when(F.col("c_custkey") % 60 != 7, F.col("c_nationkey").cast("string"))               # concat_ws leaves NULL out: a field less
    head = ",c_custkey,c_name,c_acctbal,c_nationkey"
    # every part file has a header, as Spark's own CSV writer puts one
    lines = c.select(F.concat_ws(",", index, F.col("c_custkey").cast("string"), name, bal, last).alias("value"), F.spark_partition_id().alias("p"))
    heads = lines.select("p").distinct().select(F.lit(head).alias("value"), "p")
    heads.withColumn("o", F.lit(0)).unionByName(lines.withColumn("o", F.lit(1))).repartition("p").sortWithinPartitions("p", "o").select("value", "p").write.partitionBy("p").text(f"{base}/csv")
    rows, bad = read_csv_checked(spark, f"{base}/csv/p=*", quarantine=f"{base}/bad")
    kinds = dict(rows.dtypes)
    right = kinds["c_acctbal"] == "double" and kinds["c_nationkey"] == "int" and kinds["c_custkey"] in ("int", "bigint") and list(kinds) == ["c_custkey", "c_name", "c_acctbal", "c_nationkey"]
    good = rows.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_acctbal", "c_nationkey", F.lit(None).cast("string").alias("reason"))
    broken = bad.where(F.col("file").contains("/csv/p=")).select(F.split("line", ",")[1].cast("bigint").alias("c_custkey"), "reason")
    return union_named([good, broken]).withColumn("types_right", F.lit(bool(right)))


# ------------------------------------------------------------------ P16
@query("filter_pack", f"""
SELECT 'eq_status_f' AS filter, count(*) AS n, {rs('sum(o_totalprice)')} AS price
  FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'ne_priority_urgent', count(*), {rs('sum(o_totalprice)')}
  FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'
UNION ALL SELECT 'range_price', count(*), {rs('sum(o_totalprice)')}
  FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000
UNION ALL SELECT 'isin_flag', count(*), {rs('sum(l_extendedprice)')}
  FROM lineitem WHERE l_returnflag IN ('R', 'A')
""")
def q_filter_pack(spark, sf):
    """Equality, null-safe inequality, range and isin filters, pushed to the Parquet scan."""
    o = load(spark, sf, "orders", ["o_orderstatus", "o_orderpriority", "o_totalprice"])
    li = load(spark, sf, "lineitem", ["l_returnflag", "l_extendedprice"])

    def summ(df, name, col):
        return df.agg(F.lit(name).alias("filter"), F.count(F.lit(1)).alias("n"), F.sum(col).alias("price"))
    return union_named([
        summ(o.filter(F.col("o_orderstatus") == "F"), "eq_status_f", "o_totalprice"),
        summ(o.filter(N.ne_null_safe("o_orderpriority", "1-URGENT")), "ne_priority_urgent", "o_totalprice"),
        summ(o.filter(F.col("o_totalprice").between(100000, 200000)), "range_price", "o_totalprice"),
        summ(li.filter(F.col("l_returnflag").isin("R", "A")), "isin_flag", "l_extendedprice"),
    ])


# ------------------------------------------------------------------ P17-P22 P24 J5 J11
@query("names_types_columns", f"""
SELECT o.o_orderkey AS ord_key, CAST(trunc(o.o_totalprice) AS INTEGER) AS ord_price_int,
       CAST(trunc(c.c_acctbal) AS BIGINT) AS cust_bal_long, c.c_mktsegment AS cust_segment,
       {rs('o.o_totalprice')} AS ord_total_price, 1 AS is_train,
       CAST(o.o_orderstatus = 'F' AS INTEGER) AS ord_done
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def q_names_types_columns(spark, sf):
    """Column-to-key join, prefixes, sanitised names, dtype / pattern selection, drops,
    truncating casts, source flag, duplicate-name guard (P17-P22, P24, J5, J11)."""
    o = load(spark, sf, "orders")
    c = load(spark, sf, "customer")
    oc = CL.add_affixes(o, prefix="ord_", keep=[])
    cc = CL.add_affixes(c, prefix="cust_", keep=[])
    j = oc.join(cc, oc.ord_o_custkey == cc.cust_c_custkey, "left")
    j = j.toDF(*[n.replace("_o_", "_").replace("_c_", "_") for n in j.columns])
    j = j.withColumn("ord total-price", F.col("ord_totalprice"))
    j = CL.sanitize_names(j)                               # 'ord total-price' -> 'ord_total_price'
    j = CL.drop_duplicate_names(j.select(*j.columns, F.col("ord_orderkey")))
    keep = ["ord_orderkey"] + CL.select_by_pattern(j, r"(price|acctbal|segment|status)$")
    j = j.select(*keep).drop("ord_orderstatus_unused")
    j = CL.narrow(j.withColumn("ord_price_int", F.col("ord_totalprice"))
                   .withColumn("cust_bal_long", F.col("cust_acctbal")),
                  {"ord_price_int": "int", "cust_bal_long": "bigint"})
    j = j.withColumn("ord_done", (F.col("ord_orderstatus") == "F").cast("int"))
    j = j.withColumn("is_train", F.lit(1))
    return j.select(F.col("ord_orderkey").alias("ord_key"), "ord_price_int", "cust_bal_long",
                    F.col("cust_mktsegment").alias("cust_segment"), "ord_total_price", "is_train", "ord_done")


# ------------------------------------------------------------------ P1 P2 P5 P6
@query("clean_sentinels", """
SELECT 'l_linenumber' AS col, count(*) - count(CASE WHEN l_linenumber <> 1 THEN 1 END) AS n_null FROM lineitem
UNION ALL SELECT 'l_quantity', count(*) - count(CASE WHEN l_quantity <= 40 THEN 1 END) FROM lineitem
UNION ALL SELECT 'days_ship', count(*) - count(CASE WHEN date_diff('day', DATE '1999-01-01', CAST(l_shipdate AS DATE)) < 0 THEN 1 END) FROM lineitem
UNION ALL SELECT 'o_orderpriority', count(*) - count(CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', 'XNA', 'Unknown', 'not specified', '') THEN 1 END) FROM orders
UNION ALL SELECT 'o_orderstatus', count(*) - count(CASE WHEN o_orderstatus NOT IN ('4-NOT SPECIFIED', 'XNA', 'Unknown', 'not specified', '') THEN 1 END) FROM orders
""")
def q_clean_sentinels(spark, sf):
    """Numeric sentinel, string sentinels, sign rule on *days* columns, cap -> NULL; reported as
    NULL counts per column (P1, P2, P5, P6)."""
    li = load(spark, sf, "lineitem", ["l_linenumber", "l_quantity", "l_shipdate"])
    li = li.withColumn("days_ship", F.datediff(F.col("l_shipdate"), F.lit("1999-01-01").cast("date")))
    li = CL.sentinel_to_null(li, ["l_linenumber"], 1)
    li = CL.cap_to_null(li, {"l_quantity": 40})
    li = CL.nonnegative_to_null(li, pattern="days")
    o = load(spark, sf, "orders", ["o_orderpriority", "o_orderstatus"])
    o = CL.string_sentinels_to_null(o, ["4-NOT SPECIFIED", *CL.STRING_SENTINELS])

    def nulls(df, cols):
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"),
                                                       F.col(c).isNull().cast("long").alias("z"))
                                             for c in cols])).alias("s")).groupBy("s.col").agg(
            F.sum("s.z").alias("n_null"))
    return nulls(li, ["l_linenumber", "l_quantity", "days_ship"]).unionByName(
        nulls(o, ["o_orderpriority", "o_orderstatus"]))


# ------------------------------------------------------------------ P3 P4
_R1 = "CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_extendedprice / l_discount END"
_R2 = "CASE WHEN l_tax = 0 THEN '-inf'::DOUBLE ELSE -l_extendedprice / l_tax END"


@query("clean_infinite", f"""
WITH r AS (SELECT {_R1} AS r1, {_R2} AS r2 FROM lineitem),
b AS (SELECT max(CASE WHEN isfinite(r1) THEN r1 END) AS mx1, min(CASE WHEN isfinite(r1) THEN r1 END) AS mn1,
             max(CASE WHEN isfinite(r2) THEN r2 END) AS mx2, min(CASE WHEN isfinite(r2) THEN r2 END) AS mn2 FROM r)
SELECT count(*) - count(CASE WHEN isfinite(r1) THEN 1 END) AS r1_nulls,
       count(*) - count(CASE WHEN isfinite(r2) THEN 1 END) AS r2_nulls,
       {rs("sum(CASE WHEN r1 = 'inf'::DOUBLE THEN mx1 WHEN r1 = '-inf'::DOUBLE THEN mn1 ELSE r1 END)")} AS r1_bounded_sum,
       {rs("sum(CASE WHEN r2 = 'inf'::DOUBLE THEN mx2 WHEN r2 = '-inf'::DOUBLE THEN mn2 ELSE r2 END)")} AS r2_bounded_sum,
       {rs("max(mx1)")} AS r1_max, {rs("min(mn2)")} AS r2_min
FROM r, b
""")
def q_clean_infinite(spark, sf):
    """Infinite ratios (price/discount with zero discount) -> NULL (P3) or -> finite column
    max/min (P4)."""
    li = load(spark, sf, "lineitem", ["l_extendedprice", "l_discount", "l_tax"])
    r = li.select(
        F.when(F.col("l_discount") == 0, F.lit(INF)).otherwise(F.col("l_extendedprice") / F.col("l_discount")).alias("r1"),
        F.when(F.col("l_tax") == 0, F.lit(-INF)).otherwise(-F.col("l_extendedprice") / F.col("l_tax")).alias("r2"))
    both = r.select("r1", "r2", F.col("r1").alias("b1"), F.col("r2").alias("b2"))
    both = CL.infinite_to_bounds(CL.project(both, {c: N.finite_or_null(c) for c in ("r1", "r2")}),
                                 ["b1", "b2"])
    return both.agg(F.sum(F.col("r1").isNull().cast("long")).alias("r1_nulls"),
                    F.sum(F.col("r2").isNull().cast("long")).alias("r2_nulls"),
                    F.sum("b1").alias("r1_bounded_sum"), F.sum("b2").alias("r2_bounded_sum"),
                    F.max("r1").alias("r1_max"), F.min("r2").alias("r2_min"))


# ------------------------------------------------------------------ P7 P8 P10
_TYPE_GROUPS = {"big": ["LARGE", "MEDIUM"], "small": ["SMALL", "ECONOMY"]}


@query("recode_groups", """
SELECT CASE WHEN p_type = 'PROMO' THEN 'STANDARD' ELSE p_type END AS recoded,
       CASE WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'big' WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'small'
            ELSE p_type END AS size_group,
       CASE WHEN contains(p_brand, '#1') THEN 'brand_1x' WHEN contains(p_brand, '#2') THEN 'brand_2x'
            ELSE 'brand_other' END AS brand_group,
       count(*) AS n
FROM part GROUP BY 1, 2, 3
""")
def q_recode_groups(spark, sf):
    """Single-value recode, value-list grouping, substring grouping with first match."""
    p = load(spark, sf, "part", ["p_type", "p_brand"])
    p = p.select(CL.recode("p_type", {"PROMO": "STANDARD"}).alias("recoded"),
                 CL.group_values("p_type", _TYPE_GROUPS).alias("size_group"),
                 CL.substring_group("p_brand", [("#1", "brand_1x"), ("#2", "brand_2x")], "brand_other")
                 .alias("brand_group"))
    return p.groupBy("recoded", "size_group", "brand_group").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ P9 P11 P12 P13
_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("recode_flags", """
SELECT CASE o.o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
         WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END AS prio_rank,
       CAST(abs(date_diff('day', DATE '2000-01-01', CAST(o.o_orderdate AS DATE)) / 360.0) <= 1 AS INTEGER) AS recent,
       CASE WHEN c.c_acctbal IS NULL THEN NULL WHEN c.c_acctbal >= 0 THEN 1 ELSE 0 END AS bal_sign,
       CASE WHEN month(o.o_orderdate) BETWEEN 4 AND 9 THEN 'summer' ELSE 'winter' END AS season,
       count(*) AS n
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY 1, 2, 3, 4
""")
def q_recode_flags(spark, sf):
    """Ordinal map, integer range -> label, unit-converted threshold flag, three-way sign flag
    (P9, P11, P12, P13)."""
    o = load(spark, sf, "orders", ["o_custkey", "o_orderpriority", "o_orderdate"])
    c = load(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    j = o.join(c, o.o_custkey == c.c_custkey, "left").withColumn(
        "d", F.datediff(F.col("o_orderdate"), F.lit("2000-01-01").cast("date"))).withColumn(
        "m", F.month("o_orderdate"))
    j = j.select(CL.ordinal("o_orderpriority", _PRIO).alias("prio_rank"),
                 CL.within_unit("d", 360.0, 1.0).alias("recent"),
                 CL.sign_flag("c_acctbal").alias("bal_sign"),
                 CL.int_set_label("m", [(4, 9, "summer")], "winter").alias("season"))
    return j.groupBy("prio_rank", "recent", "bal_sign", "season").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ P14 P15
@query("impute_stats", f"""
WITH d AS (SELECT nullif(l_discount, 0) AS disc, nullif(l_tax, 0) AS tax FROM lineitem),
s AS (SELECT avg(disc) AS mean_disc, median(disc) AS med_disc, max(disc) + 1 AS mx_disc,
             (SELECT tax FROM d WHERE tax IS NOT NULL GROUP BY tax ORDER BY count(*) DESC, tax LIMIT 1) AS mode_tax
      FROM d)
SELECT {rs('sum(coalesce(disc, mean_disc))')} AS by_mean, {rs('sum(coalesce(disc, med_disc))')} AS by_median,
       {rs('sum(coalesce(tax, mode_tax))')} AS by_mode, {rs('sum(coalesce(disc, mx_disc))')} AS by_max_plus_one,
       {rs('sum(coalesce(disc, 0.0))')} AS by_zero, count(*) AS n
FROM d, s
""")
def q_impute_stats(spark, sf):
    """Constant and statistic imputation (mean, median, mode, max+1), each statistic from one
    aggregate pass (P14, P15)."""
    li = load(spark, sf, "lineitem", ["l_discount", "l_tax"]).select(
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("disc"),
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax"))
    li = li.select(*[F.col("disc").alias(n) for n in ("by_mean", "by_median", "by_max_plus_one", "by_zero")],
                   F.col("tax").alias("by_mode"))
    li = CL.fill_statistic(li, ["by_mean"], "mean")
    li = CL.fill_statistic(li, ["by_median"], "median")
    li = CL.fill_statistic(li, ["by_mode"], "mode")
    li = CL.fill_statistic(li, ["by_max_plus_one"], "max_plus_one")
    li = CL.fill_constant(li, {"by_zero": 0.0})
    return li.agg(*[F.sum(c).alias(c) for c in ("by_mean", "by_median", "by_mode", "by_max_plus_one", "by_zero")],
                  F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ P23
def _narrow_sql(cols):
    parts = []
    for c, frac in cols:
        if frac:
            t = "CASE WHEN min(x) > -3.4028234663852886e38 AND max(x) < 3.4028234663852886e38 THEN 'float' ELSE 'double' END"
        else:
            t = ("CASE WHEN min(x) > -128 AND max(x) < 127 THEN 'tinyint' "
                 "WHEN min(x) > -32768 AND max(x) < 32767 THEN 'smallint' "
                 "WHEN min(x) > -2147483648 AND max(x) < 2147483647 THEN 'int' ELSE 'bigint' END")
        parts.append(f"SELECT '{c}' AS col, {t.replace('(x)', f'({c})')} AS chosen FROM orders")
    return "\nUNION ALL ".join(parts)


@query("narrow_types", _narrow_sql([("o_orderkey", False), ("o_custkey", False), ("o_totalprice", True)]))
def q_narrow_types(spark, sf):
    """Smallest type that holds each numeric column's min and max (P23), one aggregate pass."""
    o = load(spark, sf, "orders")
    t = CL.narrowest_types(o)
    return t.select(F.col("column").alias("col"), F.col("type").alias("chosen"))
