import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
#: Names that the operators use themselves; the documents of the edge cases have them, too.
CLASHING = ("size key bucket rank before fp score kept lost w lines h1 target shard slot copies text_hash grams segment "
            "digest length piece cid leaf __n __id __hash __i src level epochs value").split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Long texts are read to their end, with every word of them. " * 4000
SHARED = "this line is shared by many documents of the table, and it is long enough"


def edge_rows():
    """Null, empty, blank, very long, repeated and tied rows."""
    rows = [(1, "Some words, then a line.\n" + SHARED, "en", "b", 5), (2, None, "en", "b", None), (3, "", None, "a", 0),
            (4, " \n\t \n", "en", None, 4), (None, "A text without an id, but with words enough to count as one.", "en", "a", 1),
            (5, LONG, "de", "c", 9), (6, "twice the same row\n" + SHARED, "en", "a", 1), (6, "twice the same row\n" + SHARED, "en", "a", 1),
            (7, "one id, two texts\n" + SHARED, "en", None, 1), (7, "one id, another text\n" + SHARED.upper(), "en", "b", 1),
            (8, "  " + SHARED + "\t", "fr", "b", 1), (9, "Élan vital, naïveté, 日本語 and 🙂 in one text", "fr", "c", 3),
            (10, "a fifth document\n" + SHARED, "fr", "c", 2)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    """The edge cases with further columns whose names clash."""
    from pyspark.sql import functions as F
    d = spark.createDataFrame(edge_rows(), DOCS)
    return d.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small():
    """(doc_id, text, source) of the smallest documents table."""
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
