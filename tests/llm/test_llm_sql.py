from __future__ import annotations

import pytest

from quillspark.llm.queries import ORACLES, QUERIES

from ..compare import connect, difference


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, name, sf_dir):
    assert difference(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir) == ""
