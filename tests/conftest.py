import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, **{"spark.sql.shuffle.partitions": "8"})


@pytest.fixture
def manifest(spark):
    """Manifest of the given paths under a root; sizes default to 1."""

    def make(paths, root="/r", sizes=None):
        rows = [(root, p, s) for p, s in zip(paths, sizes or [1] * len(paths))]
        return spark.createDataFrame(rows, "root_dir string, source_path string, size bigint")

    return make


def paths_of(df):
    return sorted(r.source_path for r in df.collect())
