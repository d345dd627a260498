"""Every registered query against its DuckDB oracle (same check as the driver's)."""

import pytest

from flowsieve.plans import catalog
from tools_oracle import compare

from conftest import SF_ORACLE

KEYS = sorted(catalog.ORACLES)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, key):
    status, n1, n2, _ = compare(spark, SF_ORACLE, key, catalog.QUERIES[key], catalog.ORACLES[key])
    assert status == "ok", f"{key}: {status} spark={n1} duck={n2}"


def test_every_key_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) >= 80
