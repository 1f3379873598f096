import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(*texts, source="a"):
    return [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, long, repeated and tied rows, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one", "one", long, long + " end", "é ü 漢字 " * 30, "a\n\na\nb b b b"]
    rows = rows_of(*texts) + [(3, "one", "en", None, None), (None, "one", None, None, None), (3, "one", "en", None, None)]
    wide = [(*r, 7, "x", 1.0, "y", "i", 9, 5, "g", "k") for r in rows]
    return spark.createDataFrame(wide, SCHEMA + ", size long, part string, score double, _bin string, _id string, _crc long, _k long, _gone string, _kept string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def local(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
