import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tensorloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["many", "few"])
def ranges(request, spark):
    """Ordered scans over many small ranges, so that keys cross their borders, or as few as the rows need."""
    names = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(n) for n in names]
    if request.param == "many":
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "7")
    yield request.param
    for name, value in zip(names, before):
        spark.conf.set(name, value)
