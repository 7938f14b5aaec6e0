"""Some registered queries of every area against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry
import compare

SF = "/root/testdata/sf0.001"
PICK = ["C28_scorecard", "M5_what_if", "W8_scan", "F6_evidence_lookup", "Q5_request_screen", "R9_scope_check", "N6_lookup", "V12_detection_totals", "I6_award_notices"]


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.skipif(not os.path.exists(SF), reason="tables not here")
@pytest.mark.parametrize("name", PICK)
def test_query(spark, duck, name):
    status, n, _, note = compare.compare(spark, duck, SF, name, entry.queries(), entry.oracle_sql())
    assert status == "ok", note


def test_every_query_has_a_unique_name():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
