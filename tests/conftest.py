import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from timberline import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    base = tempfile.mkdtemp(prefix="timberline-tests-")
    found = session.build(
        "timberline-tests",
        master="local[4]",
        conf={
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": base,
        },
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture
def zones(spark):
    """Run the body of a test under two session time zones."""
    def run(check):
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            try:
                check()
            finally:
                spark.conf.set("spark.sql.session.timeZone", "UTC")

    return run
