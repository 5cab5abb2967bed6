"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, PII, mixing.

``STAGES`` lists (name, function) in order. A function takes (spark, docs, sf_dir) and returns a
DataFrame; what one stage returns is written as Parquet and reread as the next one's ``docs``. All but
the last return the columns of ``docs``; the last returns every document with what the mix takes of it, which
``run`` lays out as the corpus: whole copies and parts of the redacted texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featmart.llm.common import materialise
from featmart.llm.stages import decontaminate, deduplicate, identify, lay_out, mixture, redact

STAGES = [
    ("language_id", identify),
    ("simhash_dedup", deduplicate),
    ("decontaminate", decontaminate),
    ("pii", redact),
    ("mix", mixture),
]

# language ID, SimHash (XXH64) and the trained PII model have no SQL form; tests/llm has a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, then the corpus; each stage's result but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return lay_out(docs)
