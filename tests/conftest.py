import pytest

from wordloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__default__parallelism="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame("a string, b int", [(...), ...])"""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


RAW = "row_id bigint, file string, lang string, ord bigint, word string, frequency bigint"


@pytest.fixture
def lists(spark):
    """Lines of raw lists from {file: [(word, frequency), ...]}."""

    def make(files):
        rows, n = [], 0
        for file, words in files.items():
            for place, (word, frequency) in enumerate(words, 1):
                n += 1
                rows.append((n, file, file[:3], place, word, frequency))
        return spark.createDataFrame(rows, RAW)

    return make
