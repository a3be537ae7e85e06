import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from boxloom.session import build_session

    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
            "spark.sql.warehouse.dir": f"file://{tmp_path_factory.mktemp('warehouse')}",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def limits(spark):
    """Set engine limits for one test, to send small data down the large paths."""
    from boxloom.session import HOT_GROUP_ROWS, NESTED_BOXES

    def set_limits(hot=None, nested=None):
        if hot is not None:
            spark.conf.set(HOT_GROUP_ROWS, str(hot))
        if nested is not None:
            spark.conf.set(NESTED_BOXES, str(nested))

    yield set_limits
    spark.conf.unset(HOT_GROUP_ROWS)
    spark.conf.unset(NESTED_BOXES)
