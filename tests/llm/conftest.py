import pytest


@pytest.fixture
def table(spark):
    """A frame from rows, over more partitions than one, with extra columns that clash with names operators use."""

    def make(rows, schema, clash=()):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(rows, schema)
        return frame.withColumns({c: F.lit("clash") for c in clash})

    return make
