"""The opN queries against SQL twins where there are any, and the registration as a whole."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.twins import TESTDATA, differences
from tidelake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql_twin(spark, name):
    sf_dir = str(TESTDATA / "sf0.01")
    assert differences(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) == ""


def test_eleven_queries_are_registered():
    names = entry.queries()
    assert [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names
