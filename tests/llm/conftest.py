import pytest
from sample_docs import CLASH, SCHEMA, rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def cluttered(spark, docs):
    """The same documents with further columns of clashing names."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("clutter").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
