import pytest

CLASHES = ("n", "h", "pos", "name", "level", "fp", "component", "row", "ids", "score", "kind", "shard", "slot", "text_hash")
CLASHES += ("__made", "__redrawn", "__hash", "__text_hash", "__doc", "__id", "__sha", "__text_sha", "__chars", "__length", "__fp")
CLASHES += ("__component", "__several", "__place", "__print", "__slot", "__table_slot", "__shard", "__turn", "__right_doc_id")
CLASHES += ("batch", "run", "at", "key", "dropped", "form", "cut", "h1", "t1", "documents", "runs", "strongest", "__block", "__copy")


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in any column, empty and long texts, repeated rows, and columns named like inner ones."""
    long = " ".join(f"word{i % 977} plus{i % 13}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog " * 3),
        (2, "the quick  brown\tfox jumps over the lazy dog " * 3),
        (2, "the quick  brown\tfox jumps over the lazy dog " * 3),
        (3, ""),
        (4, None),
        (5, " \n\t "),
        (None, "a row without an id"),
        (None, "a row without an id"),
        (None, None),
        (6, long),
        (7, long + " tail"),
        (8, "ünï çode ñ 中文 😀 ​ end"),
        (9, "x" * 5000),
    ]
    return spark.createDataFrame(
        [(i, t, None, *(["7"] * len(CLASHES))) for i, t in rows],
        "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES),
    )


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def raw(small):
    """The documents of the smallest tables, and their labels."""
    import duckdb

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{small}/labels.parquet'").fetchall()
    return dict(docs), {i: (q, t) for i, q, t in labels}


@pytest.fixture(scope="session")
def tokenizer_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
