import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "a b c", "en", "s1", 3), (2, "a  b\tc", "en", "s1", 3), (2, "a  b\tc", "en", "s1", 3), (3, None, "en", None, None),
        (4, "", "fr", "s2", 0), (None, "a b c", None, "s2", 5), (5, long, "en", "s1", 9), (6, long + " end", "en", "s3", 9),
        (7, " \n ", None, "s3", 1), (8, "x" * 50_000, "de", "s2", 1), (9, "é \U0001f600 　b", "en", "s2", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 as block", "2 as fp", "3 as size", "4 as src", "5 as id", "6 as t", "7 as norm", "8 as keep", "9 as kept")
