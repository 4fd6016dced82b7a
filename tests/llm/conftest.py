import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    """The package on the workers, from wherever the tests run."""
    from hearsay.llm.shipping import ship

    ship(spark)
