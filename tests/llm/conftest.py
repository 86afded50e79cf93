import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("row", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names operators might use themselves."""

    def make(texts, ids=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or [None] * len(texts)
        return spark.createDataFrame([(i, t, x, "f", "r") for i, t, x in zip(ids, texts, langs)], DOC)

    return make
