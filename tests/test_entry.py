import re
from pathlib import Path

import __spark_entry__ as entry
from workload import ORACLE, QUERIES


def test_contract(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(QUERIES) > 100
    assert set(QUERIES) - set(ORACLE) == set()
    assert entry.entry(spark).count() > 0


def test_no_query_limits_its_tables():
    """A sample or a row cap would only look whole."""
    for path in (Path(__file__).parent.parent / "workload").glob("*.py"):
        assert not re.search(r"\.sample\(|\.limit\(", path.read_text()), path
