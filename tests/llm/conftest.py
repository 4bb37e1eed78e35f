import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) rows, over several partitions, with odd extra columns."""

    def make(rows, extra=""):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        return df.selectExpr("*", extra) if extra else df

    return make
