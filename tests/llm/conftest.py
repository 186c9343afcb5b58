import pytest
from pyspark.sql import types as T

#: Documents with everything that is odd: NULLs in any column, empty and long texts, repeated rows, clashing extra columns.
EXTRA = ["id", "key", "n", "a", "b", "component", "row", "rid", "base", "spans", "score", "stats", "label", "digest", "word", "win",
         "slot", "name", "toxic", "t", "item", "v", "kept_id", "turn", "found_id", "TURN_"]


def document_schema():
    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                         T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                         T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in EXTRA])


def as_documents(spark, rows):
    """rows: (doc_id, text, source)."""
    full = [(i, t, "en" if t else None, s, None if t is None else len(t), *["x"] * len(EXTRA)) for i, t, s in rows]
    return spark.createDataFrame(full, document_schema())


LONG = " ".join(f"word{k % 7919}x{k}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    copy = "one two three four five six seven eight nine ten eleven twelve"
    return [(1, copy, "a"), (2, copy, "a"), (3, copy.upper(), None), (3, copy.upper(), None), (4, None, "b"), (5, "", "b"),
            (6, " \t\n\x0b\x0c\r ", None), (7, "short text", "a"), (8, "Short text é ß", "c"), (9, "short text", "a"),
            (10, LONG, "a"), (11, LONG + " tail", "b"), (None, copy, "a"), (None, None, None), (12, copy + " but not the same at all now", "c"),
            (12, "another text under the same id", "c")]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return as_documents(spark, odd_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return as_documents(spark, [])
