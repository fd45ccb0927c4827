import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) pairs, with columns whose names clash with results."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), -1, "x", -1) for i, t in rows]
        return spark.createDataFrame(full, DOC + ", n_shingles int, secrets string, shard int")

    return make
