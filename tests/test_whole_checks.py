"""Queries that speak of all checks ask all of them."""

from tallyproof.plans import case_checks, eval_queries, question_queries
from tallyproof.plans.registry import ORACLES, QUERIES


def test_group_rollup_sees_bank(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(case_checks, "_load", lambda spark, sf: (None, None, None))
    monkeypatch.setattr(case_checks.C, "findings", lambda inv, con, led, day, which=tuple(case_checks.C.CHECKS): asked.append(list(which)) or spark.createDataFrame(
        [("T", k, "critical", k != "BANK-01", 0) for k in which], "tenant_id string, check_id string, severity string, passed boolean, n_flagged long"))
    assert sum(r.n_total - r.n_passed for r in QUERIES["C29_group_rollup"](spark, "").collect()) == 1
    assert [len(a) for a in asked] == [27] and "q_bank" in ORACLES["C28_scorecard"] and "q_bank" in ORACLES["C30_focus_findings"]


def test_audit_asks_all_critical_checks():
    assert "BANK-01" in question_queries.CRITICAL and "q_bank" in ORACLES["E13_answer_audit"] and "q_bank" in ORACLES["E13_releasable"]


def test_detection_asks_all_checks(spark, monkeypatch):
    monkeypatch.setattr(eval_queries, "_detected", lambda spark, sf: spark.createDataFrame(
        [("CASE-0003", k, k != "BANK-01") for k in case_checks.ORDER], "trial string, check_id string, passed boolean"))
    for t in ("invoices", "contracts", "ledger"):
        monkeypatch.setattr(eval_queries.D, t, lambda spark, sf: spark.createDataFrame([("CASE-0007",)], "tenant_id string"))
    assert [r.check_id for r in QUERIES["V13_key_reconciliation"](spark, "").collect() if r.kind == "extra"] == ["BANK-01"]
