import pytest

#: Extra columns carry names that the operators use inside.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key int, version string, anchor string, "
    "component string, kept string, found string, uid string, block string, sequence_id string, shard string, node string"
)


def rows_of(texts, lang="en"):
    return [(i, t, lang, "s", len(t or ""), *["x", 7, *["x"] * 10][:12]) for i, t in texts]


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (id, text) pairs, with clashing extra columns."""

    def make(texts, lang="en"):
        return spark.createDataFrame(rows_of(texts, lang), SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd():
    """NULLs, empty and blank texts, ties, repeated rows, one long text, ids out of order."""
    passage = " ".join(f"shared{i}" for i in range(30))
    long_text = " ".join(f"w{i % 977}x{i // 977}" for i in range(30_000))
    return [
        (5, None), (7, ""), (8, " \t\n "), (2, "one"), (3, "one"), (None, "no id"), (None, None), (11, long_text),
        (12, "alpha beta gamma " + passage), (12, "alpha beta gamma " + passage), (13, "delta " + passage + " epsilon"), (14, "a a a a a a a a a a a a a a a a a a a a a a a a a"),
        (15, "12 34 !!"), (12, "another text under a used id"), (-4, "naïve café ÉCOLE naïve"),
    ]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
