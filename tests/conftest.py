import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from grainset.session import ensure_checkpoint_dir, local_session

    s = local_session("tests", cores="*", partitions=8)
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmp_dir():
    # A fresh folder per test (with a space, to exercise path encoding).
    return tempfile.mkdtemp(prefix="grainset test-")


@pytest.fixture()
def files_read():
    """How many files the one scan of a plan without exchanges opens."""

    def count(df):
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        files = plan.collectLeaves().apply(0).metrics().get("numFiles")
        return files.get().value() if files.isDefined() else 0

    return count
