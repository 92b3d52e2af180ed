import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType()),
                     T.StructField("id", T.StringType()), T.StructField("bits", T.IntegerType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text), with extra columns whose names clash with those inside the operators."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)
    return make
