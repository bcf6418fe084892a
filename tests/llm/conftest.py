import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeated rows and ids, and columns whose names clash with those of results."""
    long = "word " * 20_000 + "end"
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "x"), (1, "alpha beta gamma delta epsilon zeta eta theta", "x"),
        (2, "ALPHA beta gamma delta epsilon zeta eta theta", None), (2, "another text under the same id", "y"),
        (3, None, "x"), (4, "", None), (5, " \t\n ", "x"), (None, "a text without an id", "y"), (6, long, "x"),
        (7, "one", None), (8, "one", "x"), (9, "wide ÄÖ 　 text 😛", None),
    ]
    names = "doc_id long, text string, lang string"
    extra = "n_lines int, n_dropped int, class string, label string, row long, mark long, words string, gate string"
    extra += ", kept int, rule int, node long, key long, component_id long, score double, labels string, leaks string"
    blank = (None,) * len(extra.split(","))
    return spark.createDataFrame([row + blank for row in rows], f"{names}, {extra}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


def as_rows(df) -> list[Row]:
    return sorted(df.collect(), key=repr)
