import pytest


@pytest.fixture(scope="session")
def texts(spark):
    """Makes a table of texts, with a column that operators don't know and one whose name clashes with theirs."""

    def make(rows, columns="doc_id long, text string"):
        frame = spark.createDataFrame(rows, columns)
        return frame.selectExpr("*", "'x' AS score", "1 AS segment", "NULL AS kept").repartition(3)

    return make
