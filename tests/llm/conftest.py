import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, extra=False):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                               T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
        rows = [(*r, *[None] * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(rows, schema)
        if extra:  # names that the operators use themselves
            for name in ("n", "node", "item", "part", "score", "spans", "places", "own", "token", "component"):
                df = df.withColumn(name, df.doc_id.cast("string"))
        return df

    return make
