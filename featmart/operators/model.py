"""Model-derived features, scoring and metrics on Spark ML.

* folds come from a hash of the entity id, ranked within each label class (whole entities, reproducible
  in SQL);
* the k models of a cross-validated run train together, one pass over the data a step (``folds``); other models
  are Spark ML estimators; scores are never collected;
* AUC is exact: a rank-sum over distinct scores whose cumulative negative counts come from the
  skew-safe chunked running sum (a single "key" holding every score is the extreme hot key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featmart.operators.seq import sequence_features
from featmart.session import cut_lineage

FOLD_SEED = 42


def hash_fold(id_col: str | Column, k: int = 5, seed: int = FOLD_SEED) -> Column:
    """Fold of an entity: first 32 bits of md5(id || '-' || seed) modulo k (M1)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(k)).cast("int")


def stratified_folds(df: DataFrame, entity: str, label: str, k: int = 5, seed: int = FOLD_SEED) -> DataFrame:
    """(entity, fold) for each entity with a label: within each label class the entities are ranked by
    their md5 hash and dealt out in turn, so whole entities stay together and every fold has each
    class's share to within one entity (M1). An entity's class is its largest label."""
    h = F.md5(F.concat(F.col(entity).cast("string"), F.lit(f"-{seed}")))
    e = df.filter(F.col(label).isNotNull()).groupBy(entity).agg(F.max(label).alias("_class")).withColumn("_h", h)
    r = sequence_features(e, "_class", ["_h", entity], {"_rn": ("row_number",)})
    return r.select(entity, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int").alias("fold"))


def _prob1(col: str = "probability") -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]


def preprocess_pipeline(numeric: Sequence[str], categorical: Sequence[str], scale: bool = True):
    """M4: mean imputation of numerics, most-frequent indexing + one-hot of categoricals (unseen
    levels -> all zeros), assembly, optional standard scaling (Spark's scaler uses the sample
    standard deviation)."""
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    stages = []
    num_out = [f"{c}__imp" for c in numeric]
    if numeric:
        stages.append(Imputer(inputCols=list(numeric), outputCols=num_out, strategy="mean"))
    idx_out = [f"{c}__idx" for c in categorical]
    oh_out = [f"{c}__oh" for c in categorical]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx_out, handleInvalid="keep",
                                    stringOrderType="frequencyDesc"))
        stages.append(OneHotEncoder(inputCols=idx_out, outputCols=oh_out, handleInvalid="keep", dropLast=True))
    stages.append(VectorAssembler(inputCols=num_out + oh_out, outputCol="_raw", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    else:
        stages[-1].setOutputCol("features")
    return stages


def logistic(n_rows: int, C: float = 1.0, max_iter: int = 100):
    """L2 logistic regression with scikit-learn's ``C`` mapped to ``regParam = 1 / (C n)``."""
    from pyspark.ml.classification import LogisticRegression
    return LogisticRegression(featuresCol="features", labelCol="_label", maxIter=max_iter,
                              regParam=1.0 / (C * max(n_rows, 1)), elasticNetParam=0.0, standardization=False)


def _prepare_numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """+-inf -> NULL before imputation (P3 inside the model input)."""
    def finite(c):
        x = F.col(c).cast("double")
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    return df.withColumns({c: finite(c) for c in features})


def _fold_by_fold(d: DataFrame, ids: list[str], label: str, numeric: Sequence[str], categorical: Sequence[str], k: int, C: float, max_iter: int) -> DataFrame:
    """A Spark ML pipeline per fold: for more columns than the sums of one pass may have."""
    from pyspark.ml import Pipeline
    lab, unl = d.filter(F.col(label).isNotNull()), d.filter(F.col(label).isNull())
    n = lab.count()
    held, test_scores = [], []
    for f in range(k):
        train = lab.filter(F.col("_fold") != f)
        model = Pipeline(stages=preprocess_pipeline(numeric, categorical) + [logistic(n, C, max_iter)]).fit(train)
        held.append(model.transform(lab.filter(F.col("_fold") == f)).select(
            *ids, F.col("_fold").alias("fold"), F.col(label), _prob1().alias("score")))
        test_scores.append(model.transform(unl).select(*ids, F.col(label), _prob1().alias("score")))
    out = held[0]
    for h in held[1:]:
        out = out.unionByName(h)
    # unlabelled rows: mean of the k models' scores - one union and one group-by, not k joins
    t = test_scores[0]
    for s in test_scores[1:]:
        t = t.unionByName(s)
    t = t.groupBy(*ids).agg(F.lit(-1).alias("fold"), F.first(label).alias(label), F.avg("score").alias("score"))
    return out.unionByName(t)


def oof_scores(df: DataFrame, id_col: str, entity_col: str, label: str, numeric: Sequence[str],
               categorical: Sequence[str] = (), k: int = 5, C: float = 1.0, max_iter: int = 100, max_columns: int | None = None) -> DataFrame:
    """Out-of-fold logistic scores (M2).

    Folds are stratified by label and assigned per entity (all rows of one entity share a fold).  For each fold f a
    model (M4 + logistic) is fitted on the labelled rows outside f and scores the labelled rows in f; unlabelled
    rows get the mean of the k models' scores (fold -1).  All models train together, one pass a Newton step (``folds``);
    with more than ``max_columns`` columns one after the other.  Returns (id, entity, fold, label, score)."""
    from featmart.operators import folds as FO
    folds = stratified_folds(df, entity_col, label, k).withColumnRenamed("fold", "_fold")
    d = _prepare_numeric(df, numeric).join(folds, entity_col, "left").withColumn("_label", F.col(label).cast("double"))
    d = d.withColumn("_fold", F.when(F.col(label).isNotNull(), F.col("_fold")))       # an unlabelled row of a labelled entity is in no fold
    # every pass reads the input: materialise it once in the shared checkpoint directory (also cuts
    # the lineage, so a lost executor does not replay the upstream joins)
    ids = [id_col] if id_col == entity_col else [id_col, entity_col]
    d = cut_lineage(d.select(*dict.fromkeys([*ids, label, "_label", "_fold", *numeric, *categorical])))
    m = FO.fit(d, label, "_fold", numeric, categorical, k, C, FO.MAX_COLUMNS if max_columns is None else max_columns)
    if m is None:
        return _fold_by_fold(d, ids, label, numeric, categorical, k, C, max_iter)
    return FO.score(d, m.design, categorical, m.weights, "_fold", [*ids, label, "_fold"]).select(
        *ids, F.coalesce("_fold", F.lit(-1)).alias("fold"), label, "score")


def auc(df: DataFrame, score: str, label: str, chunk_rows: int = 200_000, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC (ties count one half) and Gini = 2 AUC - 1 (M7, M5), optionally per group
    ``by`` (e.g. per fold, all folds in one job).

    Distinct scores with their positive / negative counts are a group-by; the cumulative
    negatives below each score come from the chunked running sum over all scores (one global
    order per group, split into blocks - no single task holds all scores)."""
    by = list(by)
    d = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    g = d.groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) == 0).cast("long")).alias("_n"))
    g = cut_lineage(g.withColumn("_all", F.lit(0)))          # read by the size check and the running sum
    c = sequence_features(g, ["_all", *by], ["_s"], {"_cn": ("running_sum", "_n")}, chunk_rows=chunk_rows)
    r = c.groupBy(*by).agg(F.sum(F.col("_p") * (F.col("_cn") - F.col("_n") * 0.5)).alias("_num"),
                           F.sum("_p").alias("_P"), F.sum("_n").alias("_N"))
    a = F.try_divide(F.col("_num"), F.col("_P") * F.col("_N"))     # NULL when one class is absent
    return r.select(*by, a.alias("auc"), (a * 2 - 1).alias("gini"), F.col("_P").alias("n_pos"),
                    F.col("_N").alias("n_neg"))


def classification_report(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Precision, recall, F1 and support per class from one confusion-matrix group-by (M8)."""
    cm = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    per_true = cm.groupBy("y").agg(F.sum("n").alias("support"))
    per_pred = cm.groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("predicted"))
    tp = cm.filter(F.col("y") == F.col("p")).select("y", F.col("n").alias("tp"))
    t = per_true.join(per_pred, "y", "full").join(tp, "y", "left").fillna(0, ["support", "predicted", "tp"])
    prec = F.try_divide(F.col("tp").cast("double"), F.col("predicted"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("support"))
    return t.select(F.col("y").alias("class"), F.coalesce(prec, F.lit(0.0)).alias("precision"),
                    F.coalesce(rec, F.lit(0.0)).alias("recall"),
                    F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"),
                    F.col("support").cast("long").alias("support"))


def cross_validate(df: DataFrame, entity_col: str, label: str, numeric: Sequence[str],
                   categorical: Sequence[str] = (), k: int = 5, C: float = 1.0) -> DataFrame:
    """k-fold AUC / Gini of the preprocessing + logistic pipeline (M5) and the fold summary
    (M9: mean, population std, min, max of the fold AUCs)."""
    sc = oof_scores(df, entity_col, entity_col, label, numeric, categorical, k, C)
    return auc(sc, "score", label, by=["fold"])


def fold_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"),
                        F.min("auc").alias("auc_min"), F.max("auc").alias("auc_max"),
                        F.avg("gini").alias("gini_mean"))


def fit_and_score(train: DataFrame, score: DataFrame, id_col: str, label: str, numeric: Sequence[str],
                  categorical: Sequence[str] = (), C: float = 1.0, model_path: str | None = None) -> DataFrame:
    """Train the pipeline on labelled rows and score another frame (M6); the fitted
    ``PipelineModel`` is saved when ``model_path`` is given.  Returns (id as int32, score)."""
    from pyspark.ml import Pipeline
    tr = _prepare_numeric(train.filter(F.col(label).isNotNull()), numeric).withColumn(
        "_label", F.col(label).cast("double"))
    n = tr.count()
    model = Pipeline(stages=preprocess_pipeline(numeric, categorical) + [logistic(n, C)]).fit(tr)
    if model_path:
        model.write().overwrite().save(model_path)
    return _scored(model, score, id_col, numeric)


def _scored(model, df: DataFrame, id_col: str, numeric: Sequence[str]) -> DataFrame:
    sc = model.transform(_prepare_numeric(df, numeric))
    return sc.select(F.col(id_col).cast("int").alias(id_col), _prob1().alias("score"))


def score_saved(model_path: str, df: DataFrame, id_col: str, numeric: Sequence[str]) -> DataFrame:
    """Scores of a pipeline that ``fit_and_score`` saved, in whatever session ``df`` belongs to (M6)."""
    from pyspark.ml import PipelineModel
    return _scored(PipelineModel.load(model_path), df, id_col, numeric)
