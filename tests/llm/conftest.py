import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(rows of (doc_id, text)) with further columns, some of which clash with names used inside."""

    def make(rows, **more):
        df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
        for name in ("h", "pos", "first", "node", "key", "__n", "recipe", "chunk", "score", "w", "base", "spans",
                     "__gone", "__removed", "__id", "__lines", "__text_h", "__words", "gone", "lines", "start", "text_h", "id", "place", "family"):
            df = df.withColumn(name, df["lang"])
        return df

    return make


EDGE = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (None, "word " * 60), (7, " \n\t "), (8, "x" * 40_000), (9, "é ü " * 3000)]


@pytest.fixture
def edge(documents):
    """Nulls, empty and very long texts, ties, a repeated row, clashing columns."""
    return documents(EDGE)


@pytest.fixture
def none(documents, spark):
    return documents([(1, "x")]).where("doc_id < 0")
