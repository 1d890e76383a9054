import pytest

from corpusmill.session import get_session
from corpusmill.sources.store import clear


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear(session)
    session.stop()
