import datetime as dt

from pyspark.sql import functions as F

from tallyproof.operators import alerts as A, metrics as M
from tests_helpers import D, con, inv, led

TODAY = D(2025, 8, 1)


def test_share_of_exactly_forty_percent_fires(spark):
    rows = lambda *amts: inv(spark, *[{"total_amount": a, "buyer_ban": f"b{i}", "buyer_name": f"n{i}"} for i, a in enumerate(amts)])
    assert [float(r.pct) for r in A.open_share(rows(40, 30, 30)).collect()] == [40.0]
    assert A.open_share(rows(34, 33, 33)).count() == 0


def test_late_payers_count_not_streak(spark):
    late = {"status": "PAID", "paid_date": D(2025, 7, 9)}
    good = {"status": "PAID", "paid_date": D(2025, 7, 1)}
    assert A.late_payers(inv(spark, late, good, late)).first().late_cnt == 2
    assert A.late_payers(inv(spark, late, good)).count() == 0


def test_repeated_billing_uses_the_whole_group(spark):
    at = lambda d: {"invoice_date": D(2025, 6, d)}
    assert A.repeated_billing(inv(spark, at(1), at(8))).count() == 2
    assert A.repeated_billing(inv(spark, at(1), at(2), at(9))).count() == 0


def test_terms_mismatch_may_match_many_contracts(spark):
    c = con(spark, {"payment_terms_days": 60}, {"payment_terms_days": 90, "expiry_date": D(2025, 12, 31)}, {"payment_terms_days": 10, "expiry_date": D(2025, 1, 2)})
    assert A.terms_mismatch(inv(spark, {}), c).count() == 2


def test_failing_rule_becomes_an_alert(spark):
    def broken(i, c, today):
        raise RuntimeError("no")
    late = lambda i, c, today: A.RULES["WATCH-02"](i, c, today)
    boom = lambda i, c, today: A.RULES["WATCH-02"](i, c, today).withColumn("amount", F.raise_error(F.lit("x")).cast("decimal(38,2)"))
    got = {r.rule_id: r for r in A.scan(inv(spark, {}), con(spark), TODAY, {"R1": broken, "WATCH-02": late, "R3": boom}, isolate=True).collect()}
    assert got["R1"].severity == got["R3"].severity == "critical" and got["WATCH-02"].n_evidence == 1


def test_fingerprint_ignores_order_and_age(spark):
    i = inv(spark, {}, {"total_amount": 7})
    fp = lambda d, t: A.headers(A.RULES["WATCH-02"](d, None, t)).first().fingerprint
    assert fp(i, TODAY) == fp(i.orderBy(F.desc("seq")), TODAY + dt.timedelta(days=3))
    assert fp(i, TODAY) != fp(inv(spark, {}, {"total_amount": 8}), TODAY)


def test_upsert_and_open(spark):
    store = spark.createDataFrame([("T", "f1", "W", "info", 1, "2025-01-01", "2025-01-01", None), ("T", "f2", "W", "info", 1, "2025-01-01", "2025-01-01", "2025-01-02")],
                                  "tenant_id string, fingerprint string, rule_id string, severity string, n_evidence long, first_seen_at string, last_seen_at string, resolved_at string")
    batch = spark.createDataFrame([("T", "f1", "W", "critical", 9), ("T", "f3", "W", "critical", 2)], "tenant_id string, fingerprint string, rule_id string, severity string, n_evidence long")
    out = {r.fingerprint: r for r in A.upsert(store, batch, F.lit("2025-02-01")).collect()}
    assert (out["f1"].first_seen_at, out["f1"].last_seen_at, out["f1"].severity) == ("2025-01-01", "2025-02-01", "info")
    assert out["f2"].last_seen_at == "2025-01-01" and out["f3"].first_seen_at == "2025-02-01"
    assert [r.fingerprint for r in A.open_alerts(A.upsert(store, batch, F.lit("2025-02-01"))).collect()] == ["f3", "f1"]


def test_ageing_edges(spark):
    due = lambda n: {"due_date": TODAY - dt.timedelta(days=n)}
    rows = {r.bucket: r.n for r in M.ageing(inv(spark, due(0), due(1), due(30), due(31), due(60), due(61), due(90), due(91), {"due_date": None}, {**due(5), "status": "void"}), TODAY).collect()}
    assert rows == {"current": 2, "1-30": 2, "31-60": 2, "61-90": 2, "over 90": 1}


def test_cash_gap_and_what_if(spark):
    i = inv(spark, {"due_date": D(2025, 8, 10), "total_amount": 100})
    bil = spark.createDataFrame([("T", 1, "AP1", "x", "s", __import__("decimal").Decimal(130), D(2025, 8, 5), "PENDING")],
                                "tenant_id string, seq long, bill_number string, supplier_ban string, supplier_name string, amount decimal(18,2), due_date date, status string")
    o = M.opening_balance(led(spark, (D(2025, 1, 1), "", 1, 50)))
    e = M.cash_events(i, bil, TODAY)
    g = M.cash_gap(M.cash_timeline(e, o), o, M.overdue_total(i)).first()
    assert (str(g.gap_date), float(g.gap_amount), float(g.trough)) == ("2025-08-05", -80.0, -80.0)
    w = {r.scenario: r for r in M.what_if(e, o, i.select("tenant_id").distinct(), TODAY, [(10, 1), (1, 60)]).collect()}
    assert w[1].verdict == "lower trough" and float(w[1].trough_drop) == 10 and w[2].verdict == "no effect"


def test_lookup_falls_back_to_party(spark):
    i = inv(spark, *[{} for _ in range(7)])
    refs = spark.createDataFrame([("T", "AB10000000"), ("T", "04595257"), ("T", "C0"), ("T", "zz")], "tenant_id string, ref string")
    got = M.lookup_evidence(refs, i, con(spark, {}), led(spark)).collect()
    assert sorted((r.ref, r.kind) for r in got) == [("04595257", "invoice by party")] * 5 + [("AB10000000", "invoice"), ("C0", "contract")]
