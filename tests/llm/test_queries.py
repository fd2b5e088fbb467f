import os

import pytest

from quillon.llm.queries import QUERIES, SQL
from tests.conftest import SMALL
from tests.sqlcheck import agree

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, name):
    agree(spark, QUERIES[name], SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_all_problems_have_queries():
    assert {n.split("_")[0] for n in QUERIES} == {"p1", "p2", "p3", "p4", "p6", "p7", "p8", "p9"}
