"""Registered queries against their SQL on the smallest test tables.

``python tests/compare.py`` does the same for every query and any folder.
"""

import pytest

from __spark_entry__ import oracle_sql, queries
from opsreview.plans.catalog import QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
NAMES = (
    "kpi_rollup", "period_features", "eg001_unescalated", "eg002_uninvestigated", "eg003_unremediated", "ns001_silent_assets",
    "ns002_vanished_telemetry", "pb001_peer_deviation", "trend_scores", "mrd001_divergence", "running_baseline",
    "if_rep001_repetitive", "if_dev002_deviation", "if_mea003_missing_action", "an001_notable_features", "findings",
    "evidence_refs", "queue_merge", "ingest_alert_issues", "dataset_audit",
)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    n, problem = difference(spark, con, FOLDER, name, queries()[name], oracle_sql()[name])
    assert problem == "" and n >= 0


def test_every_query_but_the_forest_has_sql():
    without = set(QUERIES) - set(oracle_sql())
    assert without == {"an001_isolation_forest", "assessment_findings", "assessment_summary"}
