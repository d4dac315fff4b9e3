import pytest

#: Columns that operators use inside; inputs may bring their own.
CLASHING = ["n", "key", "keys", "node", "line", "lines", "size", "digest", "bucket", "shard", "part", "spans", "shingles", "score", "doc", "text_", "lo"]


@pytest.fixture
def documents(spark):
    """(doc_id, text) rows as a table with a source, a language and columns of clashing names."""

    def make(rows, sources=None):
        data = [(i, t, (sources[k] if sources else "s"), "en", *["x"] * len(CLASHING)) for k, (i, t) in enumerate(rows)]
        schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


ODD = [(1, None), (2, ""), (3, "   \t "), (4, "one"), (5, "one"), (None, "one"), (None, None), (6, "Ünïcode ß text here now"), (6, "Ünïcode ß text here now")]


@pytest.fixture
def odd_rows():
    return list(ODD)
