import pytest

SMALL = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, repeated rows, odd characters and a long text.
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one two three"),
    (5, "one two three"),
    (5, "one two three"),
    (6, "Ünï cödé  😀 \x1c naïve\u2003x"),
    (7, "word " * 30000),
    (8, "".join(f"w{i % 977} " for i in range(20000))),
    (None, "no id here at all"),
    (9, "<|endoftext|> a<|endoftext|>b"),
    (10, "UNDER THE MIT LICENSE under the mit license"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd rows, and extra columns whose names operators use inside."""
    rows = [(i, t, "x", 1, "y", 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, h long, row string, length long").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}
