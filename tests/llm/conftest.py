import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and a clashing extra column."""
    rows = [
        (1, "one two three four five six seven eight. Again\n\nand more", "en", "a", 3), (1, "one two three four five six seven eight. Again\n\nand more", "en", "a", 3),
        (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id here", None, "b", 1), (4, "word " * 30_000, "en", "a", 150_000),
        (5, "x" * 9000, "en", "c", 9000), (6, "naïve Ünïcode 'tis it's \U0001f600 end", "en", None, 1), (7, "\n \n\t\n", "en", "a", 5),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("length", F.lit(1))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
