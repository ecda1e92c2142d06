from __future__ import annotations

import pytest

import support  # noqa: F401  puts the repository on the path
from tarnwheel.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        cores=4,
        settings={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split_small(spark):
    """Make every key with more than four rows a hot one."""
    spark.conf.set("tarnwheel.window.rowsPerTask", "4")
    yield
    spark.conf.unset("tarnwheel.window.rowsPerTask")
