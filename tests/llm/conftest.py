import pytest
from samples import TEXTS


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with operators' own names."""
    rows = [(i, t, 1, "x", 2.0, None, t) for i, t in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, id int, set string, score double, n int, words string"
    )


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
