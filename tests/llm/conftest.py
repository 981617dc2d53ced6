import pytest

LONG = "word " * 40_000
SHARED = "a passage of more than fifty bytes that several of these documents hold, word for word"
#: Nulls, empty and blank texts, ties, repeated rows, one very long text, one very long word, text beyond ASCII.
ROWS = [
    (1, "the same text", "en"),
    (2, "the same text", None),
    (2, "the same text", "en"),
    (3, None, "en"),
    (4, "", "de"),
    (5, " \n\t ", "de"),
    (6, LONG, "en"),
    (7, "x" * 120_000, "en"),
    (8, f"Before. {SHARED}. After it.", "fr"),
    (9, f"{SHARED} and then some other words", "fr"),
    (10, "Ümläute, ñandú, 漢字 and 🎉 emoji; É and é", "es"),
    (11, "THE SAME TEXT", "en"),
    (None, "no key", "en"),
    (None, "no key", "en"),
    (12, "one", None),
]
DOCS = "doc_id long, text string, lang string"
#: Columns that operators themselves return.
CLASHES = ("shard", "slot", "row", "digest", "keep_id", "ids", "decoded", "runs", "items", "n_words", "fingerprint", "component_id", "score", "kept", "bucket", "block")


@pytest.fixture(scope="session")
def stored_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(ROWS, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def clashing_docs(spark, stored_docs, tmp_path_factory):
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("docs") / "clashing.parquet")
    stored_docs.select("*", *[F.lit("own").alias(c) for c in CLASHES]).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "empty.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)
