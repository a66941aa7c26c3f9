import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with those the operators make.
CLASHES = ("size", "shard", "slot", "fp", "key", "did", "n_words", "taken", "target", "score", "lang_pred", "accepted", "component", "evidence", "x", "b", "h", "copies")


@pytest.fixture(scope="session")
def edge_rows():
    long = " ".join(f"word{i % 977} item{i}" for i in range(30_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "a"), (4, "One two three four five six.", "en", "a"), (5, "One two three four five six.", "en", "b"),
        (6, long, "en", "b"), (7, long + " tail", None, None), (8, "ünïcode 𝔘 text für alle.  nbsp", "de", "a"), (9, "!!! ??? 123 456", "de", None),
        (10, "a" * 3000, "fr", "a"), (None, "no id at all here", "fr", "a"), (12, "same row", "fr", "a"), (12, "same row", "fr", "a"), (13, "x", "es", "c"),
    ]
    return [(d, t, la, s, len(t or "")) for d, t, la, s in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    docs = spark.createDataFrame(edge_rows, COLUMNS)
    return docs.withColumns({c: F.lit("clash") for c in CLASHES}).persist()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    from common_checks import SF

    return spark.read.parquet(f"{SF}/documents.parquet").persist()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
