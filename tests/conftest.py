import pytest

from vigilmesh.adapters import Tables
from vigilmesh.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(shuffle_partitions=4, memory="8g", checkpoint=str(tmp_path_factory.mktemp("checkpoint")))


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)
