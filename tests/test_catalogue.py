"""Every query of the catalogue against its SQL twin, at two sizes."""

from __future__ import annotations

import pytest

from tests.twins import TESTDATA, differences
from tidelake.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql_twin(spark, name, sf):
    sf_dir = str(TESTDATA / sf)
    assert differences(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_a_twin_gives_rows(spark, name):
    assert QUERIES[name](spark, str(TESTDATA / "sf0.001")).count() > 0
