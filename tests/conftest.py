import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from billweave.session import local_session  # noqa: E402


# started at import: column expressions at module level need a session
SESSION = local_session("tests", 8, 4)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """evaluate(rows, schema, columns…) -> list of tuples in input order."""

    def run(rows, schema, *columns):
        df = spark.createDataFrame(
            [(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}"
        )
        out = df.select("_i", *[c.alias(f"c{n}") for n, c in enumerate(columns)])
        return [tuple(r)[1:] for r in sorted(out.collect(), key=lambda r: r["_i"])]

    return run
