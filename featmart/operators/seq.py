"""Order-aware features within an entity.

One rule set, two physical forms of it:

* Entities of at most ``chunk_rows`` rows: ``Window.partitionBy(key).orderBy(order)``, one shuffle.
* Entities above it (found by a count by hash, then an exact one of the key columns if need be) are cut into blocks of
  ``chunk_rows`` consecutive rows, and each block is a window partition of its own:

  1. ``positions`` numbers the rows exactly (range partitions and a chunk table, no window over
     the entity).
  2. Every block gets copies of the rows just before it (for lag, rolling, EWM) and just after it
     (for lead) that its features need; the copies are dropped at the end.
  3. Running sums, entity totals and the last EWM value come across blocks from a table with one
     row per (key, block).

Only the large entities take the second form, so one hot key does not send the others through it.
Both forms give the same rows: a NULL key is an entity like any other, and a NULL order value sorts
last (SURVEY §1.1) unless the caller passes an explicit sort order. The order must be total (unique)
within a key.

EWM has no look-back limit. With positions cut into spans of ``L`` rows, the weighted sum at a row is
the running sum inside its span, weighted from the span's start, plus what earlier spans carry in;
numerator and denominator share the decay factor, which cancels, so nothing overflows. ``L`` makes a
span decay to 1e-100, so the four spans before hold every term that a double can represent. A NULL
row repeats the last value, since both sums decay alike.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmart.functions.nulls import flag
from featmart.session import cut_lineage

CHUNK_ROWS = 1_000_000
ROWS_PER_RANGE_PARTITION = 2_000_000
EWM_SPANS = 4
KEY_BUCKETS = 1 << 16         # keys are counted by hash first: a table of bounded size


def ewm_span(alpha: float) -> int:
    """Rows after which (1 - alpha)^L is about 1e-100."""
    beta = 1.0 - alpha
    return 1 if beta <= 0 else max(1, int(100 * math.log(10) / -math.log(beta)))


def _ord(o) -> Column:
    return F.col(o).asc_nulls_last() if isinstance(o, str) else o


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the key columns of ``left`` are kept."""
    names = {k: f"_r_{i}" for i, k in enumerate(keys)}
    r = right.withColumnsRenamed(names)
    cond = F.lit(True)
    for k, n in names.items():
        cond = cond & left[k].eqNullSafe(r[n])
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def _reach(features: Mapping[str, tuple]) -> tuple[int, int]:
    """Rows before and after a block that its features read."""
    before, after = 0, 0
    for spec in features.values():
        kind = spec[0]
        if kind in ("diff", "increase", "prev"):
            before = max(before, 1)
        elif kind == "lag":
            before = max(before, int(spec[2]))
        elif kind == "lead":
            after = max(after, int(spec[2]))
        elif kind == "rolling_mean":
            before = max(before, int(spec[2]) - 1)
        elif kind == "ewm":
            before = max(before, EWM_SPANS * ewm_span(float(spec[2])))
    return before, after


def _window_exprs(part: Sequence[str], order: Sequence, features: Mapping[str, tuple], halo: Column | None, kinds: Mapping[str, str]) -> dict:
    """Window expressions for every feature but EWM; ``halo`` marks copied rows, which sums skip; ``kinds``: the columns' types."""
    w = Window.partitionBy(*part).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*part)

    def own(x: Column) -> Column:
        return x if halo is None else F.when(~halo, x)

    out = {}
    for name, spec in features.items():
        kind, col = spec[0], (F.col(spec[1]) if len(spec) > 1 and isinstance(spec[1], str) else None)
        if kind == "diff":
            fill = spec[2] if len(spec) > 2 else 0.0
            out[name] = F.coalesce(col - F.lag(col, 1).over(w), F.lit(fill))
        elif kind == "lag":
            out[name] = F.lag(col, int(spec[2])).over(w)
        elif kind == "lead":
            out[name] = F.lead(col, int(spec[2])).over(w)
        elif kind == "prev":
            out[name] = F.lag(col, 1).over(w)
        elif kind == "increase":
            out[name] = flag(col > F.lag(col, 1).over(w))
        elif kind == "running_sum":
            out[name] = F.when(col.isNull(), F.lit(0.0)).otherwise(F.coalesce(F.sum(own(col)).over(run), F.lit(0.0)))
        elif kind == "running_count":
            out[name] = F.count(own(col)).over(run)
        elif kind == "key_sum":
            out[name] = F.coalesce(F.sum(own(col)).over(whole), F.lit(0.0))
        elif kind == "key_count":
            out[name] = F.count(own(F.lit(1))).over(whole)
        elif kind == "rolling_mean":
            n = int(spec[2])
            if n <= 4 and kinds.get(spec[1]) == "double":
                # a short window is read as lags, which cost less than a sliding frame; summed in the order in which AVG sums
                v = F.lit(0.0)
                for back in range(n - 1, -1, -1):
                    v = v + (F.lag(col, back).over(w) if back else col)
                v = v / F.lit(float(n))
            else:
                fr = w.rowsBetween(-(n - 1), Window.currentRow)
                v = F.when(F.count(col).over(fr) == n, F.avg(col).over(fr))
            out[name] = F.coalesce(v, F.lit(spec[3])) if len(spec) > 3 else v
        elif kind == "row_number":
            out[name] = F.row_number().over(w).cast("bigint")
        elif kind != "ewm":
            raise ValueError(f"unknown sequence feature {kind!r}")
    return out


def _add_ewm(df: DataFrame, part: Sequence[str], name: str, col: str, alpha: float, halo: Column | None, largest: int | None = None) -> DataFrame:
    """Add the EWM column (pandas ``adjust=True, ignore_na=False``); needs ``_pos``. ``largest``: no fewer than the rows of the
    largest partition, if that is known: it has no more spans than they fill. What is read in order of position shares
    a sort with what is read by span."""
    beta, span, x = 1.0 - alpha, ewm_span(alpha), F.col(col).cast("double")
    real = x.isNotNull() if halo is None else x.isNotNull() & ~halo
    if beta <= 0:
        by_pos = Window.partitionBy(*part).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.last(F.when(real, x), ignorenulls=True).over(by_pos))
    d = df.withColumn("_span", F.floor((F.col("_pos") - 1) / span)).withColumn("_in", F.col("_pos") - 1 - F.col("_span") * span)
    grow, fade = F.pow(F.lit(1.0 / beta), F.col("_in")), F.pow(F.lit(beta), F.lit(span) - F.col("_in"))
    d = d.withColumns({"_xg": x * grow, "_wg": F.when(x.isNotNull(), grow), "_xf": x * fade, "_wf": F.when(x.isNotNull(), fade)})
    run = Window.partitionBy(*part, "_span").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"_num": F.coalesce(F.sum("_xg").over(run), F.lit(0.0)), "_den": F.coalesce(F.sum("_wg").over(run), F.lit(0.0))})
    num, den = F.col("_num"), F.col("_den")
    for back in range(1, 1 + (EWM_SPANS if largest is None else min(EWM_SPANS, (max(largest, 1) - 1) // span))):
        earlier = Window.partitionBy(*part).orderBy("_span").rangeBetween(-back, -back)
        decay = F.lit(beta ** (span * (back - 1)))
        num = num + F.coalesce(F.sum("_xf").over(earlier), F.lit(0.0)) * decay
        den = den + F.coalesce(F.sum("_wf").over(earlier), F.lit(0.0)) * decay
    d = d.withColumns({"_num": num, "_den": den}).withColumn("_y", F.when(real, F.col("_num") / F.col("_den")))
    by_pos = Window.partitionBy(*part).orderBy("_span", "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn(name, F.last("_y", ignorenulls=True).over(by_pos)).drop(
        "_span", "_in", "_xg", "_wg", "_xf", "_wf", "_num", "_den", "_y")


def positions(df: DataFrame, key: Sequence[str], order: Sequence, n_parts: int | None = None) -> DataFrame:
    """Add ``_pos``: exact 1-based row number of every row inside its key, in ``order``, without a
    window over the key. The rows are range-partitioned by (key, order) into about
    ``ROWS_PER_RANGE_PARTITION`` rows each, numbered inside their partition, and a table with a row
    per (key, partition) gives the offset of each partition."""
    key = list(key)
    if n_parts is None:
        base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n_parts = max(base, -(-df.count() // ROWS_PER_RANGE_PARTITION))
    by = [F.col(k) for k in key] + [_ord(o) for o in order]
    s = df.repartitionByRange(n_parts, *by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id())
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_idx", F.col("_mid").bitwiseAND((1 << 33) - 1))
    # read by two branches: two evaluations of a range exchange would sample different bounds
    s = cut_lineage(s)
    chunks = s.groupBy(*key, "_pid").agg(F.min("_idx").alias("_i0"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*key, "_pid", "_i0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = null_safe_join(s, chunks, [*key, "_pid"])
    return out.withColumn("_pos", F.col("_off") + F.col("_idx") - F.col("_i0") + 1).drop("_mid", "_pid", "_idx", "_i0", "_off")


def large_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows, by an exact count of the key columns (counted map-side)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)


def within(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    """Whether no key can have more than ``limit`` rows: the rows are counted by a hash of the key, in at most
    ``KEY_BUCKETS`` groups a task, so that no key is shuffled. A key's rows all fall into one group."""
    n = df.groupBy(_bucket(*keys).alias("_b")).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("n")).first()["n"]
    return n is None or n <= limit


def _bucket(*keys) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit(KEY_BUCKETS - 1))


def largest_keys(parts: Mapping[str, tuple], hashed: Sequence[str] = ()) -> dict[str, int]:
    """Rows of the largest key of several frames by one shuffled count. parts: name -> (frame, keys, weight): at most two
    keys, a whole number and a text, either may be None; weight: a Column of row counts, or None for one a row. For the
    parts ``hashed`` the number is no smaller than that: they are counted by a hash of the key (``within``)."""
    one = None
    for name, (df, (number, text), weight) in parts.items():
        number = F.lit(None) if not number else _bucket(number) if name in hashed else F.col(number)
        d = df.select(F.lit(name).alias("_part"), number.cast("bigint").alias("_number"),
                      (F.col(text) if isinstance(text, str) else F.lit(None) if text is None else text).cast("string").alias("_text"),
                      (F.lit(1) if weight is None else weight).cast("bigint").alias("_w"))
        one = d if one is None else one.unionByName(d)
    n = one.groupBy("_part", "_number", "_text").agg(F.sum("_w").alias("n")).groupBy("_part").agg(F.max("n").alias("n"))
    return {r["_part"]: r["n"] for r in n.collect()}                   # a row per part


def _plain(df: DataFrame, keys: list[str], order: Sequence, features: Mapping[str, tuple], largest: int | None = None) -> DataFrame:
    by = [_ord(o) for o in order]
    exprs = _window_exprs(keys, by, features, None, dict(df.dtypes))
    ewm = [n for n, s in features.items() if s[0] == "ewm"]
    if not ewm:
        return df.select("*", *[e.alias(n) for n, e in exprs.items()])
    out = df.select("*", *[e.alias(n) for n, e in exprs.items()],
                    F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("bigint").alias("_pos"))
    for n in ewm:
        out = _add_ewm(out, keys, n, features[n][1], float(features[n][2]), None, largest)
    return out.select(*df.columns, *features)


def _chunked(df: DataFrame, keys: list[str], order: Sequence, features: Mapping[str, tuple], chunk_rows: int) -> DataFrame:
    before, after = _reach(features)
    spans = {ewm_span(float(s[2])) for s in features.values() if s[0] == "ewm"}
    if len(spans) > 1:
        raise ValueError("one call computes EWMs of one alpha")
    for span in spans:                   # a block holds whole spans
        chunk_rows = -(-chunk_rows // span) * span
    pos = positions(df, keys, order)
    at = F.col("_pos") - 1
    pos = pos.withColumn("_blk", F.floor(at / F.lit(chunk_rows)))
    none = F.array().cast("array<bigint>")
    later = F.floor((at + before) / chunk_rows)
    earlier = F.greatest(F.lit(0).cast("bigint"), F.floor((at - after) / chunk_rows))
    copies = F.concat(F.when(later > F.col("_blk"), F.sequence(F.col("_blk") + 1, later)).otherwise(none),
                      F.when(earlier < F.col("_blk"), F.sequence(earlier, F.col("_blk") - 1)).otherwise(none))
    dealt = F.concat(F.array(F.struct(F.col("_blk").alias("b"), F.lit(False).alias("h"))),
                     F.transform(copies, lambda b: F.struct(b.alias("b"), F.lit(True).alias("h"))))
    rows = pos.withColumn("_copy", F.explode(dealt)).withColumn("_blk", F.col("_copy.b")).withColumn("_halo", F.col("_copy.h")).drop("_copy")
    part, halo = [*keys, "_blk"], F.col("_halo")
    exprs = _window_exprs(part, [F.col("_pos")], features, halo, dict(df.dtypes))
    for n, s in features.items():
        if s[0] == "row_number":
            exprs[n] = F.col("_pos")
    out = rows.select("*", *[e.alias(n) for n, e in exprs.items()])
    ewm = [n for n, s in features.items() if s[0] == "ewm"]
    for n in ewm:
        out = _add_ewm(out, part, n, features[n][1], float(features[n][2]), halo)
    out = out.where(~halo)
    sums = {n: s for n, s in features.items() if s[0] in ("running_sum", "running_count", "key_sum", "key_count")}
    if sums:
        def total(s):
            return {"running_sum": lambda: F.sum(s[1]), "key_sum": lambda: F.sum(s[1]), "running_count": lambda: F.count(s[1]),
                    "key_count": lambda: F.count(F.lit(1))}[s[0]]()
        tot = pos.groupBy(*part).agg(*[total(s).alias(f"_t_{n}") for n, s in sums.items()])
        prior = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
        tot = tot.select(*part, *[F.coalesce(F.sum(f"_t_{n}").over(whole if s[0].startswith("key") else prior), F.lit(0)).alias(f"_o_{n}")
                                  for n, s in sums.items()])
        out = null_safe_join(out, tot, part, "left")
        for n, s in sums.items():
            if s[0].startswith("key"):
                out = out.withColumn(n, F.col(f"_o_{n}"))
            else:
                moved = F.col(n) + F.col(f"_o_{n}")
                out = out.withColumn(n, F.when(F.col(s[1]).isNull(), F.col(n)).otherwise(moved) if s[0] == "running_sum" else moved)
    if ewm:
        out = cut_lineage(out)       # read by the table of last values and by the result
        lasts = out.groupBy(*part).agg(*[F.max_by(n, "_pos").alias(f"_l_{n}") for n in ewm])
        prior = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        lasts = lasts.select(*part, *[F.last(f"_l_{n}", ignorenulls=True).over(prior).alias(f"_p_{n}") for n in ewm])
        out = null_safe_join(out, lasts, part, "left")
        for n in ewm:
            out = out.withColumn(n, F.coalesce(n, f"_p_{n}"))
    return out.select(*df.columns, *features)


def sequence_features(df: DataFrame, key: str | Sequence[str], order: Sequence, features: Mapping[str, tuple],
                      chunk_rows: int | None = None, adaptive: bool = True, sizes: DataFrame | None = None,
                      largest: int | None = None) -> DataFrame:
    """Add order-aware features per key. Keys with more than ``chunk_rows`` rows (default
    ``CHUNK_ROWS``) are cut into blocks; ``adaptive=False`` cuts every key (for tests). ``sizes``: a
    frame with the key columns and at least as many rows per key, if counting it is cheaper. ``largest``: no fewer than the rows of the
    largest key, where they have been counted before (``largest_keys``).

    features: name -> spec, where spec is one of
      ("diff", col[, fill])          x - previous x; first row of the key gets ``fill`` (W2)
      ("lag", col, k), ("lead", col, k)   value k rows back / ahead (W9)
      ("prev", col)                  previous value
      ("increase", col)              1 if x > previous x else 0 (W5)
      ("running_sum", col)           cumulative sum skipping NULL; NULL rows give 0 (W4)
      ("running_count", col)         cumulative non-NULL count
      ("key_sum", col), ("key_count",)    sum / rows of the whole key
      ("rolling_mean", col, n[, fill]) mean of the last n rows, only when all n are non-NULL (W3)
      ("ewm", col, alpha)            exponentially weighted mean, adjust=True (W7)
      ("row_number",)                1-based position within the key
    """
    keys = [key] if isinstance(key, str) else list(key)
    chunk_rows = chunk_rows or CHUNK_ROWS
    if not adaptive:
        return _chunked(df, keys, order, features, chunk_rows)
    if largest is not None and largest <= chunk_rows:
        return _plain(df, keys, order, features, largest)
    if within(df if sizes is None else sizes, keys, chunk_rows):
        return _plain(df, keys, order, features, chunk_rows)
    hot = large_keys(df if sizes is None else sizes, keys, chunk_rows)
    if hot.isEmpty():
        return _plain(df, keys, order, features, chunk_rows)
    hot = cut_lineage(hot)               # few rows, read by both branches
    cold = _plain(null_safe_join(df, hot, keys, "left_anti"), keys, order, features, chunk_rows)
    return cold.unionByName(_chunked(null_safe_join(df, hot, keys, "left_semi"), keys, order, features, chunk_rows))


def first_last_k(df: DataFrame, key: str, order: Sequence[str], first_k: int | None = None, last_k: int | None = None) -> DataFrame:
    """The first k rows of each key (``_first``) and the last k (``_last``), for a conditional aggregation afterwards
    (W6, O5). A row that is both comes twice, with one flag each. Either end is a window whose rank is limited, so
    a task keeps at most k rows of a key before the exchange: no row beyond them is shuffled, and a hot key brings k rows
    a task."""
    up = [_ord(o) for o in order]
    down = [F.col(o).desc_nulls_first() for o in order]
    parts = []
    for k, by, flags in ((first_k, up, (True, False)), (last_k, down, (False, True))):
        if k is not None:
            rn = F.row_number().over(Window.partitionBy(key).orderBy(*by))
            parts.append(df.withColumn("_rn", rn).where(F.col("_rn") <= k).drop("_rn").withColumns({"_first": F.lit(flags[0]), "_last": F.lit(flags[1])}))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def flag_first_last_k(df: DataFrame, key: str, order: Sequence[str], first_k: int | None = None,
                      last_k: int | None = None, chunk_rows: int | None = None, adaptive: bool = True) -> DataFrame:
    """All rows with the flags ``_first`` (among the first k of its key) and ``_last`` (among the last k), for slices that
    need every row's place anyway."""
    s = sequence_features(df, key, order, {"_rn": ("row_number",), "_cnt": ("key_count",)}, chunk_rows, adaptive)
    if first_k is not None:
        s = s.withColumn("_first", F.col("_rn") <= first_k)
    if last_k is not None:
        s = s.withColumn("_last", F.col("_rn") > F.col("_cnt") - last_k)
    return s.drop("_cnt")


def lookalike_clusters(df: DataFrame, attrs: Sequence[str], id_col: str, counts: DataFrame | None = None, n_clusters: int | None = None) -> DataFrame:
    """Rows equal on ``attrs`` form a cluster when there are at least two of them.

    Cluster size comes from an aggregate + join (no window over a possibly hot attribute
    combination); ``counts`` (attrs, _n) if it is there already, with ``n_clusters`` rows of two or more. The cluster
    number is the group's rank by size (largest first), then attributes; the group table is numbered by
    ``positions``, so it may be of any length."""
    attrs = list(attrs)
    counts = df.groupBy(*attrs).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    sizes = counts.filter(F.col("_n") > 1).withColumn("_one", F.lit(0))
    parts = None if n_clusters is None else max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_clusters // ROWS_PER_RANGE_PARTITION))
    ranked = positions(sizes, ["_one"], [F.desc("_n"), *[F.col(a).asc_nulls_last() for a in attrs]], parts)
    return null_safe_join(df, ranked.select(*attrs, F.col("_pos").alias("cluster"), F.col("_n").alias("cluster_size")), attrs, "left")


def neighbour_labels(df: DataFrame, cluster: str, order: Sequence[str], label: str,
                     chunk_rows: int | None = None, adaptive: bool = True, largest: int | None = None) -> DataFrame:
    """Next / previous label inside a cluster ordered by ``order``, in one pass; NULL outside clusters
    (W9). The neighbour's label is a leak-prone feature: it reads another entity's target."""
    inside = df.filter(F.col(cluster).isNotNull())
    none = F.lit(None).cast(df.schema[label].dataType)
    outside = df.filter(F.col(cluster).isNull()).withColumns({"prev_label": none, "next_label": none})
    both = sequence_features(inside, cluster, order, {"prev_label": ("lag", label, 1), "next_label": ("lead", label, 1)}, chunk_rows, adaptive, largest=largest)
    return both.unionByName(outside)
