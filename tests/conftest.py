import pytest

from lakeloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
