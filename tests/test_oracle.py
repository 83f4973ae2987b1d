"""A cross-section of the registered queries against their SQL at the smallest scale."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connect
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
CHECKED = (
    "contract_evolution",
    "interpolate_by_time",
    "resample_1w",
    "resample_1mo",
    "gaps_sliced",
    "faults_zero_flow",
    "trend",
    "enriched",
    "dq_report_sliced",
    "stream_dedupe",
)
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="shared tables not here")


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert queries().keys() >= QUERIES.keys() and oracle_sql().keys() >= ORACLE.keys()


def test_entry(spark):
    assert len(entry(spark).columns) == 11


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, queries()[name], oracle_sql()[name], SF_DIR) is None
