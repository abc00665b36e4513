import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def docs(spark):
    def make(*texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en" if i % 2 else None, "s", 0, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)

    return make
