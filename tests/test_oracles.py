"""Every registered query with SQL, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare
from tests.conftest import SMALL

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    problem, rows, _ = compare(spark, name, QUERIES[name], ORACLE[name], SMALL)
    assert problem is None
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    # What SQL cannot express is held against brute force: the forest in test_forest, training text in tests/llm.
    own = {name for name in set(QUERIES) - set(ORACLE) if name != "pipeline" and not name.startswith("op")}
    assert own == {"review_risk"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
