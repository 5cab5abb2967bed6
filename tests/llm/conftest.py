import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with every kind of trouble: nulls, empty, very long, repeated, clashing extra columns."""
    long = "Wort eins zwei " * 20_000
    rows = [(1, "the cat sat on the mat", "en", "b"), (1, "the cat sat on the mat", "en", "b"), (2, None, "en", None),
            (3, "", None, "a"), (None, "the cat sat on the mat", None, None), (4, "   \n\t ", "de", "a"), (5, long, "de", None),
            (6, "1234 5678 +1 (555) 555-0100 x@y.de", "xx", "é"), (1, "another text under the same id", "en", "b"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # names that operators use inside
    clash = ("id", "fp", "k1", "k2", "size", "taken", "h", "w", "spans", "row", "score", "rejected", "target", "_row_key0", "cls", "v")
    return df.withColumns({"n_chars": F.length("text").cast("long")} | {c: F.lit(7) for c in clash})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
