import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30000))
CLASH = "size int, shard int, n int, class int, row int, block int, part int, target double, _key int, _kept int, taken int, _row_no int"


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in all columns, empty, blank and very long texts, ties, repeated rows."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "b"), (4, same, "en", None),
        (5, same, "en", "b"), (5, same, "en", "b"), (None, same, None, None), (6, LONG, "de", "b"),
        (7, LONG + " end", "de", "a"), (8, "two words", "en", "a"), (9, "TWO WORDS", "en", "c"),
        (10, "mail a.b@c.example.org now. you idiot! call +1 (755) 555-9729 or 10.2.3.4", "en", "c"),
        (None, None, None, None), (11, "été 　 naïve\xa0x \U0001f600", "fr", "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    frame = spark.createDataFrame(odd_rows, "doc_id bigint, text string, lang string, source string")
    extra = (f"cast(7 as {c.split()[1]}) as `{c.split()[0]}`" for c in CLASH.split(", "))
    return frame.selectExpr("*", "cast(length(text) as bigint) as n_chars", *extra)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
