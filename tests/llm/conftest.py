import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text, source) rows, with extra columns whose names operators might use."""

    def build(rows):
        df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)
        from pyspark.sql import functions as F

        for name in ("score", "row", "_size", "_text", "size", "key", "id", "fp", "shard", "length", "chunk", "_src", "target", "block"):
            df = df.withColumn(name, F.lit(1))
        return df

    return build


ODD = [
    (0, None, None), (1, "", "a"), (2, "   \n\t ", "a"), (3, "word", None), (4, "word", ""), (4, "word", ""), (4, "other words here", "b"),
    (None, "no id at all", "b"), (None, None, None), (5, "é日本語 \U0001f600 text " * 3, "c"), (6, "long " * 30_000, "c"), (7, "x" * 50_000, "c"),
]
