"""Every query with SQL gives the rows of its SQL; the others give rows."""
import os

import pytest

from oracle import compare, connect
from tramline.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: What the smallest tables hold none of.
NONE = {"cli_01_executor", "rte_03_all_journeys_scan", "rte_12_journeys_in_isochrone", "rte_03_all_journeys", "flt_04_select_trip", "par_03_extend_backwards", "rte_08_expand_search", "srt_02_journeys_by_departure", "api_05_between_places", "api_07_latest_departure"}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, DATA).count() > 0
        return
    found = compare(con, spark, DATA, QUERIES[name], ORACLES[name])
    assert found is None or (found == "no rows" and name in NONE), found
