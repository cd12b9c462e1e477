import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for p in (str(ROOT), str(ROOT / "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)


@pytest.fixture(scope="session")
def spark():
    from tallymix.session import local_session

    session = local_session(8, "tests", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """A planted table laid out once: (matrix, labels, CountData)."""
    from planted import as_counts, planted
    from tallymix.operators.cells import prepare
    from tallymix.workspace import Workspace

    x, labels = planted()
    return x, labels, prepare(as_counts(spark, x), Workspace(spark))


@pytest.fixture(scope="session")
def sliced(spark):
    """The same table with hot keys cut into slices and no broadcast of feature tables."""
    from planted import as_counts, planted
    from tallymix.operators.cells import prepare
    from tallymix.workspace import Workspace

    x, labels = planted()
    return x, labels, prepare(as_counts(spark, x), Workspace(spark), slice_rows=8, bucket_rows=200, broadcast_bytes=0)
