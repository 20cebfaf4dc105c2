import pytest

from tastelake.session import local_session
from tastelake.sources.views import Views


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    return Views(spark, "/root/testdata/sf0.001")
