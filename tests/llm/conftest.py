import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in "documents pages conversations labels benchmark embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (0, None, "en", "a"), (1, "", "en", "a"), (2, " \t\n", None, None), (3, long, "en", "b"), (4, long, "en", "b"), (4, long, "en", "b"), (5, "one two three", "en", "b"), (6, "one two three", "fr", None),
        (7, f"x y {passage} z", "en", "c"), (8, f"{passage} tail words", "en", "c"), (9, "é 日本 <|endoftext|> <|im_end|> \x00 ok", "en", "a"), (10, "word " * 300, "en", "a"), (None, "no key at all but words", "en", "a"), (11, passage, None, "b"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, "s", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size long, row string, kept boolean")
    return docs.repartition(3)
