"""Every registered query against its DuckDB SQL on whole tables."""

import pytest

from tests.conftest import SF_DIR
from workloads.check import compare
from workloads.oracles import ORACLES
from workloads.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, SF_DIR, name) is None
