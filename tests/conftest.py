import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from salesloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SCHEMA = "brand string, model string, sales_volume string, sales_price string, energy_type string"


@pytest.fixture
def sales(spark):
    """Rows given as (brand, model, volume, price, category), all as text."""
    def make(rows, extra="", more=()):
        return spark.createDataFrame(rows, SCHEMA + extra)
    return make
