"""One small local session for all tests."""

import pytest

from siltstone.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("shared")
    s = local_session(4, 4, app="tests", **{"spark.checkpoint.dir": f"file://{base}", "spark.sql.warehouse.dir": str(base / "warehouse")})
    yield s
    s.stop()
