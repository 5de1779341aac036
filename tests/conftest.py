import pytest

from urnstat.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, app="tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture
def draws_of(spark):
    """Draws from (series, draw_id, ISO date or None, balls, bonus) rows."""

    def make(rows):
        df = spark.createDataFrame(rows, "series string, draw_id bigint, day string, balls array<int>, bonus int")
        return df.selectExpr("series", "draw_id", "cast(day as date) as draw_date", "balls", "bonus")

    return make
