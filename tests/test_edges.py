import os

import pytest

from quillon.plans.catalog import QUERIES
from tests import edgetables
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


def test_core_on_empty_tables(spark, tmp_path):
    at = edgetables.write("empty", SMALL, tmp_path)
    for name in ("p5_found", "p5_report", "rsa_model_pairs", "accepted_images", "sync_manifest", "manifest_checks", "io_json", "label_closure"):
        assert QUERIES[name](spark, at).count() == 0, name


def test_orphans_with_nulls_everywhere(spark, tmp_path):
    at = edgetables.write("nulls", SMALL, tmp_path)
    assert QUERIES["p5_found"](spark, at).count() > 0
