from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from campaign_analytics.session import build_session

    scratch = tempfile.mkdtemp(prefix="campaign-tests-")
    session = build_session(
        "local[4]",
        shuffle_partitions=8,
        app_name="campaign-analytics-tests",
        extra={
            "spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
            "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
        },
    )
    yield session
    session.stop()


@pytest.fixture()
def scratch_dir():
    return tempfile.mkdtemp(prefix="campaign-test-run-")
