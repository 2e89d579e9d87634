import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Frame of (doc_id, text[, lang[, source]]) rows with the columns of documents."""
    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


#: Names that the operators use for their own columns.
CLASHES = ["score", "kept", "copies", "size", "members", "target", "rep", "key", "n", "unit", "_id", "_row", "pos",
           "lang_pred", "rejected", "spans", "base", "piece", "length", "host", "bands", "removed_chunks", "_p", "_k"]


@pytest.fixture(scope="session")
def clashing():
    """The same frame with a column of each clashing name added."""
    from pyspark.sql import functions as F

    def add(df):
        return df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})
    return add
