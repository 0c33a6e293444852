import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make(spark):
    """Rows (doc_id, text) as a documents table over several partitions."""

    def build(rows, parts=3, **more):
        rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        df = spark.createDataFrame(rows, DOCS)
        return (df.repartition(parts) if rows else df).withColumns(more)

    return build


@pytest.fixture(scope="session")
def sf_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def corpus(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (None, "no id here"), (5, "repeat me"), (5, "repeat me"), (6, "naïve ñandú 漢字 😀 <|endoftext|> don't"), (7, "word " * 3000), (8, "!!! ???")]
