import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shelfsort.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, app="shelfsort-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed_labels(spark):
    from shelfsort.operators.labels import empty_labels, seed_insert
    from shelfsort.sources.store import builtin_seeds
    return seed_insert(empty_labels(spark), builtin_seeds(spark)).cache()
