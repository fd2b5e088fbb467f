import os

import pytest

from quillon.llm.queries import QUERIES
from tests import edgetables
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
ONE_ROW = {"p6_checks", "p8_checks", "p8_fill"}


@pytest.fixture(scope="module", params=["empty", "nulls"])
def tables(request, tmp_path_factory):
    return request.param, edgetables.write(request.param, SMALL, tmp_path_factory.mktemp(request.param))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    kind, at = tables
    n = QUERIES[name](spark, at).count()
    assert n == (1 if name in ONE_ROW else 0) if kind == "empty" else n > 0
