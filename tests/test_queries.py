import os

import pytest

from quillon.plans import catalog
from tests.conftest import SMALL
from tests.sqlcheck import agree

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_is_its_sql(spark, name):
    agree(spark, catalog.QUERIES[name], catalog.SQL[name], SMALL)


def test_greedy_images(spark):
    df = catalog.QUERIES["greedy_images"](spark, SMALL)
    per = df.where("accepted").groupBy("concept").count().collect()
    assert per and all(r["count"] <= 15 for r in per)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["model_a", "model_b", "rho", "n_edges"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
