import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from samples import awkward, documents, frame, with_clashes  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, documents()).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, awkward())


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def clashing(odd):
    return with_clashes(odd)
