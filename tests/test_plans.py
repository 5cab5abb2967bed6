"""Physical-plan properties: pruned scans, pushed filters, partial aggregation, no Python in
the hot path of the flagship."""

import os

from pyspark.sql import functions as F

from featmart.plans.catalog import RAW

SF = os.environ.get("FEATMART_TEST_SF", "/root/testdata/sf0.001")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_scans_are_pruned_and_filtered(spark):
    plan = _plan(RAW["customer_mart"](spark, SF))
    # lineitem is read with only the five columns the mart uses
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double,l_returnflag:string," in plan
    assert "l_quantity" not in plan and "l_tax" not in plan and "l_partkey" not in plan
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in plan
    assert "partial_" in plan                      # map-side partial aggregation before the shuffle
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_filters_reach_the_scan(spark):
    plan = _plan(RAW["filter_pack"](spark, SF))
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "In(l_returnflag" in plan


def test_group_stats_use_aggregate_and_join(spark):
    plan = _plan(RAW["join_back"](spark, SF))
    assert "Window" not in plan                    # J6 is aggregate + join, not a window over the group


def _scans(plan, column):
    """How many scans of the final plan read ``column`` (lines of the plan's tree)."""
    return sum(1 for line in plan.splitlines() if "FileScan parquet" in line and column in line)


def test_single_pass_aggregates(spark):
    for name, column in (("agg_all_numeric", "o_custkey"), ("cond_agg_category", "o_custkey")):
        plan = _plan(RAW[name](spark, SF))
        assert _scans(plan, column) == 1 and plan.count("Exchange hashpartitioning") == 1, name


def test_two_step_aggregate_reads_each_table_once(spark):
    plan = _plan(RAW["two_step_agg"](spark, SF))
    assert _scans(plan, "l_partkey") == 1 and _scans(plan, "o_custkey") == 1
    assert "Expand" not in plan


def test_profile_has_no_join_per_column(spark):
    plan = _plan(RAW["agg_mixed_profile"](spark, SF))
    assert "Expand" not in plan and plan.count("Join") == 1 and _scans(plan, "o_custkey") == 2


def test_sequence_and_quantile_plans(spark):
    seq = _plan(RAW["seq_diff_running"](spark, SF))
    assert seq.count("Exchange hashpartitioning") == 1 and "Join" not in seq       # no large key: one window, one shuffle
    med = _plan(RAW["dist_pack"](spark, SF))
    assert "partial_count" in med                  # equal values are counted before the shuffle
    assert "rangepartitioning" not in med          # nothing is sorted as a whole


def _jobs(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(name)), out


def test_final_mart_starts_few_jobs_and_scans_little(spark):
    from featmart.plans import marts as M
    from featmart.sources import load
    tables = [load(spark, SF, t) for t in ("customer", "nation", "orders", "lineitem", "events")]
    jobs, df = _jobs(spark, "final-mart", lambda: M.final_marts(*tables))
    assert jobs <= 12
    plan = _plan(df)
    # one scan of the customers for D1 and D8; before the plan the counts and the medians read them once each
    assert _scans(plan, "c_custkey") <= 2 and _scans(plan, "o_orderkey") <= 2 and _scans(plan, "l_linenumber") == 1


def test_optimal_bins_write_their_input_once(spark, monkeypatch):
    import featmart.session as session
    from featmart.operators import encode as EN
    cols = [f"x{i}" for i in range(12)]
    df = spark.range(500).select(*[(F.col("id") * (i + 3) % 101).cast("double").alias(c) for i, c in enumerate(cols)], (F.col("id") % 3 == 0).cast("int").alias("y"))
    seen, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda d: seen.append(d.columns) or cut(d))
    jobs, _ = _jobs(spark, "bins", lambda: EN.optimal_bins(df, "y", cols))
    assert [c for c in seen if {*cols} <= {*c}] == [["_y", *cols]] and jobs <= 25


def test_hot_value_does_not_fill_a_partition(spark):
    """90 % equal values: what is ranked is a row per distinct value."""
    from pyspark.sql import functions as F

    from featmart.operators import seq
    d = spark.range(20_000).select(F.lit(0).alias("k"), F.when(F.col("id") % 10 > 0, F.lit(1.0)).otherwise(F.col("id").cast("double")).alias("v"))
    c = d.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    p = seq.positions(c, ["k"], ["v"], n_parts=16).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in p) == 2_001
