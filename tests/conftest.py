import pytest

from loomgraph.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4, "tests")
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return s


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
