from __future__ import annotations

import os

import pytest

os.environ.setdefault("DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from rillmark.session import local_session

    at = tmp_path_factory.mktemp("shared")
    session = local_session("tests", 4, **{"spark.checkpoint.dir": str(at)})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
