"""The driver's contract: names, SQL for known queries, and every query over its whole tables on the smallest scale."""

import __spark_entry__ as entry
import pytest

from weft.plans.registry import QUERIES

from .conftest import DATA


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "p5_found" in QUERIES and not [q for q in QUERIES if q[0] == "p" and not q.startswith("p5_")]


def test_the_core_does_not_import_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['weft.llm'] = None\nimport __spark_entry__ as e, weft.plans.registry; assert not [q for q in e.queries() if q.startswith('p1_')]; assert 'p5_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])


@pytest.mark.parametrize("name", ["p5_found", "x24_dependencies", "j12_resolve_edges", "a18_relevance", "j14_parent_turns"])
def test_queries_run(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0
