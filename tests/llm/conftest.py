import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session", autouse=True)
def training_ready(spark):
    from ragloom.llm.registry import ready

    ready(spark)
