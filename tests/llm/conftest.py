import pytest

TEXT = ["alpha beta gamma delta epsilon zeta eta theta iota kappa", None, "", "  \n\t ", "one", "x " * 3000]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, short, long and repeated texts; null and repeated ids; clashing extra columns."""
    rows = [(i, t, "en", "a", 1, 5) for i, t in enumerate(TEXT)]
    rows += [(0, TEXT[0], "en", "a", 1, 5), (None, TEXT[0], None, None, 1, 5), (7, TEXT[0].upper(), "de", "b", 1, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, node int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
