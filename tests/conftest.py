import pytest

from weirlog.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session(8, "weirlog-tests")


@pytest.fixture
def place(spark):
    """Fresh folders; pytest's own would be removed under running queries."""
    from weirlog.session import scratch

    return lambda name: scratch(spark, f"test-{name}")
