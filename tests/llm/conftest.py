import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with the awkward cases every operator must take."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:  # names that operators use themselves
            for name in ("key", "row", "score", "start", "bucket", "ids", "__kept"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


LONG = "lorem ipsum dolor " * 20_000
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "two words"), (5, "same text here"), (5, "same text here"), (6, LONG), (7, "é😀 \x00")]
