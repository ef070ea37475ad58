import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracewarden.plans.session import local_session  # noqa: E402

# Test modules build columns at import, which needs a session.
SESSION = local_session(8, "tests")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def texts(spark):
    """Rows of one text column, in order."""

    def make(*values):
        return spark.createDataFrame(list(enumerate(values)), "i int, t string")

    return make


@pytest.fixture
def apply(texts):
    """Values of an expression over texts, in order."""

    def run(expression, *values):
        rows = texts(*values).select("i", expression.alias("out")).collect()
        return [r["out"] for r in sorted(rows, key=lambda r: r["i"])]

    return run
