import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def llm(spark):
    from sitelens.llm.common import setup
    return setup(spark)


@pytest.fixture(scope="session")
def make_docs(llm):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, lang, source)."""
        return llm.createDataFrame([(r[0], r[1], *(r[2:] or (None, None)), len(r[1]) if r[1] is not None else None) for r in rows], DOCS).repartition(3)
    return make


@pytest.fixture(scope="session")
def small(llm):
    """The documents of the smallest given size, as rows and as a table."""
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, [r.asDict() for r in docs.collect()]
