import pytest

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture
def docs(spark):
    """Frame of (doc_id, text, source, ...extra) rows with columns whose names operators use too."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", 1, "x", "y") for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, source string, n int, id string, found string")

    return build
