"""featmart: feature tables from relational history, expressed as lazy Spark DataFrame plans.

Subpackages
-----------
functions  column-level building blocks (NULL / zero-division contract, row statistics)
operators  DataFrame -> DataFrame operators (cleaning, aggregation, joins, sequences,
           encoding, selection, profiles, model-derived features)
sources    table loading with explicit schemas, CSV/Parquet sinks, spec hand-off
plans      feature marts composed from operators and the query catalogue
"""

from featmart.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
