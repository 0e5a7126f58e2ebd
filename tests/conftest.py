import pytest

from altloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture
def one(spark):
    """Evaluate a column function on plain texts."""

    def run(make, *values):
        rows = [(n, v) for n, v in enumerate(values)]
        df = spark.createDataFrame(rows, "n int, t string")
        return [r[0] for r in df.orderBy("n").select(make("t")).collect()]

    return run
