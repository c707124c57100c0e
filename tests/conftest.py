from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lumenfield.session import local_session

    session = local_session("tests", "4", "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cat(spark):
    from lumenfield.plans.registry import Catalogue

    return Catalogue(spark, DATA)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="lumenfield-test-")
