import pytest

from cartulario.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, **{"spark.default.parallelism": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()
