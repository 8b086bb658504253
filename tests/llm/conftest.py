import pytest

#: Names that operators use inside; a table may have columns of these names.
CLASHING = "size score target taken name rows c key sig root node doc row label stats piece offset length rank text_hash digest lined found shard order block"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in CLASHING.split())


def make(spark, rows):
    """Documents `(doc_id, text, lang, source)` with the columns of `documents` and many clashing ones."""
    extra = tuple("x" for _ in CLASHING.split())
    return spark.createDataFrame([(i, t, la, so, len(t) if t is not None else None, *extra) for i, t, la, so in rows], SCHEMA)


LONG = " ".join(f"word{i % 977}x" for i in range(30_000))

EDGE = [
    (None, "null id here with some more words", "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "Hello World, this is a text.", "en", "a"),
    (5, "hello world, this is a text.", "en", None), (5, "hello world, this is a text.", "en", None), (6, LONG, "en", "a"), (7, LONG, "fr", "b"), (8, "über Ärger 漢字 😀 <|endoftext|> don't", "de", "b"),
    (9, "123 456 !!! ###", None, "c"), (10, "a", "en", "c"), (10, "b", "en", "c"), (11, "x\x1cy\x85z w v", "en", "a"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return make(spark, EDGE).cache()


@pytest.fixture(scope="session")
def empty(spark, edge):
    return spark.createDataFrame([], edge.schema)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
