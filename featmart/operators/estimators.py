"""Encoders as Spark ML estimators: usable in a ``Pipeline``, saved with it, loaded by another job.

Each estimator fits with the function of ``encode`` that does the work and keeps the fitted tables as DataFrames of
any length; its model writes its parameters as Spark ML metadata and its tables as Parquet beside it, so a
``PipelineModel`` of these and of Spark's own stages is saved and loaded as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featmart.operators import encode as EN
from featmart.session import cut_lineage


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"tables": sorted(self.instance.tables)})
        for name, table in self.instance.tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls()
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        out.tables = {name: self.sparkSession.read.parquet(f"{path}/tables/{name}") for name in metadata["tables"]}
        return out


class _TableModel(Model, MLReadable, MLWritable):
    """A fitted model: parameters and named tables."""

    def __init__(self):
        super().__init__()
        self.tables: dict[str, DataFrame] = {}

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)

    def copy(self, extra=None):
        out = super().copy(extra)
        out.tables = dict(self.tables)
        return out


def _model(estimator: Params, cls, **tables: DataFrame):
    """A ``cls`` with the estimator's parameters and the written tables."""
    out = estimator._copyValues(cls())
    out._resetUid(estimator.uid)
    out.tables = {k: cut_lineage(t) for k, t in tables.items()}
    return out


class FiniteOrNull(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """NaN and infinities of the input columns become NULL."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def finite(c):
            x = F.col(f"`{c}`").cast("double")
            return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
        return dataset.withColumns({c: finite(c) for c in self.getInputCols()})


class _Suffix(Params):
    suffix = Param(Params._dummy(), "suffix", "what is put behind a column's name for the new column; empty: in its place", TypeConverters.toString)


class _WoeParams(HasInputCols, HasLabelCol, _Suffix):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    bins = Param(Params._dummy(), "bins", "quantile bins of a numeric column", TypeConverters.toInt)
    formula = Param(Params._dummy(), "formula", "'rate_odds' or 'standard'", TypeConverters.toString)
    missingValue = Param(Params._dummy(), "missingValue", "value for what was not seen", TypeConverters.toFloat)


class WoeModel(_TableModel, _WoeParams):
    """Replaces columns by their weights of evidence."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        missing = self.getOrDefault(self.missingValue) if self.isDefined(self.missingValue) else None
        return EN.woe_apply(dataset, self.tables["woe"], self.getOrDefault(self.suffix), missing)


class WoeEncoder(Estimator, _WoeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Weights of evidence of categorical (``inputCols``) and numeric columns on the labelled rows."""

    @keyword_only
    def __init__(self, *, inputCols=None, numericCols=None, labelCol="label", suffix="_woe", bins=10, formula="rate_odds", missingValue=None):
        super().__init__()
        self._setDefault(inputCols=[], numericCols=[], labelCol="label", suffix="_woe", bins=10, formula="rate_odds")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> WoeModel:
        get = self.getOrDefault
        return _model(self, WoeModel, woe=EN.woe_fit(dataset, self.getLabelCol(), self.getInputCols(), get(self.numericCols), get(self.bins), formula=get(self.formula)))


class _CodeParams(HasInputCols, _Suffix):
    order = Param(Params._dummy(), "order", "'sorted' or 'frequency'", TypeConverters.toString)


class LevelCodeModel(_TableModel, _CodeParams):
    """Adds each level's code; NULL and unseen levels are -1."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def add(df: DataFrame, c: str) -> DataFrame:
            return EN.codes_apply(df, c, self.tables["codes"].where(F.col("feature") == c), c + self.getOrDefault(self.suffix))
        return reduce(add, self.getInputCols(), dataset)


class LevelCoder(Estimator, _CodeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Codes of the levels in sorted order or by frequency."""

    @keyword_only
    def __init__(self, *, inputCols=None, order="sorted", suffix="_code"):
        super().__init__()
        self._setDefault(order="sorted", suffix="_code")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LevelCodeModel:
        one = EN.sorted_codes_fit if self.getOrDefault(self.order) == "sorted" else EN.frequency_codes_fit
        each = [one(dataset, c).select(F.lit(c).alias("feature"), F.col("level").cast("string").alias("level"), "code") for c in self.getInputCols()]
        return _model(self, LevelCodeModel, codes=reduce(DataFrame.unionByName, each))


class _QuantileParams(HasInputCols, _Suffix):
    bins = Param(Params._dummy(), "bins", "number of quantile bins", TypeConverters.toInt)


class QuantileBinModel(_TableModel, _QuantileParams):
    """Adds each value's bin (E4); NULL outside the fitted range."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges: dict[str, list[float]] = {c: [] for c in self.getInputCols()}
        for r in self.tables["edges"].orderBy("feature", "edge").collect():           # columns x bins
            edges[r["feature"]].append(r["edge"])
        return dataset.withColumns({c + self.getOrDefault(self.suffix): EN.bin_index(c, e) for c, e in edges.items()})


class QuantileBinner(Estimator, _QuantileParams, DefaultParamsReadable, DefaultParamsWritable):
    """Quantile edges of numeric columns."""

    @keyword_only
    def __init__(self, *, inputCols=None, bins=10, suffix="_bin"):
        super().__init__()
        self._setDefault(bins=10, suffix="_bin")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> QuantileBinModel:
        edges = EN.quantile_edges_fit(dataset, self.getInputCols(), self.getOrDefault(self.bins))
        rows = [(c, float(e)) for c, es in edges.items() for e in es]
        return _model(self, QuantileBinModel, edges=dataset.sparkSession.createDataFrame(rows, "feature string, edge double"))


class _SupervisedParams(HasInputCols, HasLabelCol, _Suffix):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    prebins = Param(Params._dummy(), "prebins", "pre-bins of a column", TypeConverters.toInt)
    minShare = Param(Params._dummy(), "minShare", "least share of the rows a bin holds", TypeConverters.toFloat)
    trend = Param(Params._dummy(), "trend", "trend of the bins' event rates", TypeConverters.toString)
    missingValue = Param(Params._dummy(), "missingValue", "value for what is in no bin", TypeConverters.toFloat)


class SupervisedBinModel(_TableModel, _SupervisedParams):
    """Adds the weight of evidence of each value's bin."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges: dict[str, list[float]] = {}
        for r in self.tables["edges"].orderBy("feature", "edge").collect():           # columns x pre-bins
            edges.setdefault(r["feature"], []).append(r["edge"])
        bins = EN.Bins(edges, self.tables["levels"], self.tables["bins"], self.getInputCols())
        return EN.binned_apply(dataset, bins, suffix=self.getOrDefault(self.suffix), missing_value=self.getOrDefault(self.missingValue))


class SupervisedBinner(Estimator, _SupervisedParams, DefaultParamsReadable, DefaultParamsWritable):
    """Optimal bins of categorical (``inputCols``) and numeric columns on the labelled rows."""

    @keyword_only
    def __init__(self, *, inputCols=None, numericCols=None, labelCol="label", prebins=20, minShare=0.05, trend="monotone", missingValue=0.0, suffix="_binned"):
        super().__init__()
        self._setDefault(inputCols=[], numericCols=[], labelCol="label", prebins=20, minShare=0.05, trend="monotone", missingValue=0.0, suffix="_binned")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> SupervisedBinModel:
        get, spark = self.getOrDefault, dataset.sparkSession
        b = EN.optimal_bins(dataset, self.getLabelCol(), get(self.numericCols), self.getInputCols(), get(self.prebins), get(self.minShare), trend=get(self.trend))
        rows = [(c, float(e)) for c, es in b.edges.items() for e in es]
        levels = b.levels if b.levels is not None else spark.createDataFrame([], "feature string, value string, prebin int")
        return _model(self, SupervisedBinModel, bins=b.table, levels=levels, edges=spark.createDataFrame(rows, "feature string, edge double"))
