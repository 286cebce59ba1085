import pytest
from nasty import SCHEMA, nasty_rows


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(nasty_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def duck(nasty):
    import duckdb

    con = duckdb.connect()
    con.register("documents", nasty.toArrow())
    return con
