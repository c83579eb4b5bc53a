"""The corpus operators' queries against their SQL."""

import pytest
from tests.test_queries import duck, rows  # noqa: F401

from ledgerleaf.llm import registry
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):  # noqa: F811
    got, want = registry.queries()[name](spark, SMALL).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
