import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyproof.operators import checks as C, reconcile as R

AS_OF = dt.date(2026, 1, 1)
INV = "tenant_id string, seq long, invoice_number string, invoice_date date, due_date date, paid_date date, seller_ban string, buyer_ban string, buyer_name string, sales_amount decimal(18,2), tax_amount decimal(18,2), total_amount decimal(18,2), payment_terms_days int, status string"
CON = "tenant_id string, seq long, contract_number string, buyer_ban string, payment_terms_days int, effective_date date, expiry_date date, annual_commitment_amount decimal(18,2)"
LED = "tenant_id string, seq long, txn_date date, reference string, amount decimal(18,2), balance decimal(18,2)"
D = dt.date


def dec(x):
    from decimal import Decimal
    return None if x is None else Decimal(str(x))


def inv(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        b = dict(tenant_id="T", seq=i + 1, invoice_number=f"AB{10000000 + 7 * i}", invoice_date=D(2025, 6, 2), due_date=D(2025, 7, 2), paid_date=None, seller_ban="22099131", buyer_ban="04595257",
                 buyer_name="B", sales_amount=1000, tax_amount=50, total_amount=1050, payment_terms_days=30, status="PENDING")
        b.update(r)
        for k in ("sales_amount", "tax_amount", "total_amount"):
            b[k] = dec(b[k])
        out.append(tuple(b[c.split()[0]] for c in INV.split(", ") if c.split()[0] in b))
    return spark.createDataFrame(out, INV)


def con(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        b = dict(tenant_id="T", seq=i + 1, contract_number=f"C{i}", buyer_ban="04595257", payment_terms_days=30, effective_date=D(2025, 1, 1), expiry_date=None, annual_commitment_amount=0)
        b.update(r)
        b["annual_commitment_amount"] = dec(b["annual_commitment_amount"])
        out.append(tuple(b.values()))
    return spark.createDataFrame(out, CON)


def led(spark, *rows):
    return spark.createDataFrame([("T", i + 1, r[0], r[1], dec(r[2]), dec(r[3])) for i, r in enumerate(rows)], LED)


def run(i, c, l, *checks):
    return {r.check_id: r for r in C.findings(i, c, l, AS_OF, checks or tuple(C.CHECKS)).collect()}


def test_clean_invoice_passes(spark):
    f = run(inv(spark, {}), con(spark), led(spark), "TAXID-01", "ARITH-01", "FRAUD-01")
    assert all(r.passed for r in f.values())


def test_conditional_findings(spark):
    """23 findings without contracts and ledger rows but with data, 25 at most when both miss; all 27 when all is there."""
    bare = run(inv(spark, {}), con(spark), led(spark))
    assert len(bare) == 25 and "TERM-03" not in bare and "CONTRACT-02" not in bare
    assert {k for k, r in bare.items() if r.severity == "info"} == {"RELATED-01", "TERM-02", "CONTRACT-01", "BANK-01", "LEDGER-01", "FORENSIC-02"}
    nodata = run(inv(spark, {"sales_amount": None, "invoice_date": None}), con(spark), led(spark))
    assert len(nodata) == 23
    full = run(inv(spark, {}), con(spark, {}), led(spark, (D(2025, 1, 1), "", 5, 5), (D(2025, 1, 2), "", 5, 10)))
    assert len(full) == 27


def test_traps(spark):
    i = inv(spark,
            {"seller_ban": "abc", "buyer_ban": None},                       # two ids that clean to nothing count as equal
            {"seller_ban": "12345678", "buyer_ban": "12345678"},            # both roles fail the checksum, and self-dealing
            {"total_amount": None}, {"tax_amount": -1, "sales_amount": 1000, "total_amount": 999},
            {"total_amount": 50_000_001, "sales_amount": 50_000_001, "tax_amount": 0},
            {"invoice_date": D(2026, 1, 2), "due_date": D(2026, 1, 1)}, {"due_date": D(2026, 6, 3)}, {"invoice_number": None}, {"invoice_number": None},
            {"sales_amount": 30, "tax_amount": 2, "total_amount": 32})      # 1.5 rounds to 2 (half to even)
    f = run(i, con(spark), led(spark))
    assert list(f["FRAUD-01"].refs) == ["AB10000000", "AB10000007"]
    assert f["TAXID-01"].n_flagged == 3 and list(f["TAXID-01"].refs).count("AB10000007") == 2
    assert list(f["AMT-01"].refs) == ["AB10000014"]
    assert list(f["AMT-02"].refs) == ["AB10000021"]
    assert list(f["AMT-03"].refs) == ["AB10000028"]
    assert list(f["DATE-01"].refs) == list(f["DATE-02"].refs) == ["AB10000035"]
    assert list(f["DATE-03"].refs) == ["AB10000042"]
    assert list(f["DUP-01"].refs) == ["None"]
    assert "AB10000063" not in f["ARITH-02"].refs and f["ARITH-01"].passed


def test_tolerances(spark):
    f = run(inv(spark, {"total_amount": 1051}, {"total_amount": 1051.01}, {"tax_amount": 51.5, "total_amount": 1051.5}, {"tax_amount": 51.51, "total_amount": 1051.51}), con(spark), led(spark), "ARITH-01", "ARITH-02")
    assert list(f["ARITH-01"].refs) == ["AB10000007"]
    assert list(f["ARITH-02"].refs) == ["AB10000021"]


def test_last_contract_wins(spark):
    c = con(spark, {"payment_terms_days": 60}, {"payment_terms_days": 30, "effective_date": D(2025, 6, 3)}, {"buyer_ban": "xx", "payment_terms_days": 90})
    f = run(inv(spark, {}, {"buyer_ban": "yy"}), c, led(spark), "TERM-02", "TERM-03")
    assert list(f["TERM-02"].refs) == ["AB10000007"]        # ids that clean to nothing share the last entry
    assert list(f["TERM-03"].refs) == ["AB10000000", ] and f["TERM-03"].n_flagged == 1


@pytest.mark.parametrize("seed", range(3))
def test_consecutive_numbers(spark, seed):
    rnd = random.Random(seed)
    nums = [rnd.randrange(999_990, 1_000_040) for _ in range(25)] + [10 ** 18 - 2, 10 ** 18 - 1, 10 ** 18]
    i = inv(spark, *[{"invoice_number": f"X{n:06d}"} for n in nums])
    vals, run_, best = sorted(nums), 1, 1
    for a, b in zip(vals, vals[1:]):
        run_ = run_ + 1 if b - a == 1 else 1
        best = max(best, run_)
    got = C.consecutive_runs(i, block=10).collect()
    assert [r.ref for r in got] == [f"04595257(run {best})"]


def test_contract_amounts(spark):
    i = inv(spark, *[{"total_amount": a, "buyer_ban": b} for a, b in [(10, "04595257"), (900, "22099131"), (800, "04595257"), (700, "22099131"), (500, "04595257"), (1, "04595257"), (2, "04595257"), (3, "04595257")]])
    f = run(i, con(spark, {"annual_commitment_amount": 600}), led(spark), "CONTRACT-01", "CONTRACT-02")
    assert list(f["CONTRACT-01"].refs) == ["AB10000007"]    # threshold is the second largest of eight, 800
    assert list(f["CONTRACT-02"].refs) == ["04595257(1310/600x2)"]


@pytest.mark.parametrize("block", [1, 2, 100])
def test_ledger_steps_over_rows(spark, block):
    l = led(spark, (D(2025, 1, 1), "", 5, 100), (D(2025, 1, 2), "", 5, None), (D(2025, 1, 3), "", 10, 110), (D(2025, 1, 4), "", 1, 112), (D(2025, 1, 5), "", 1, 114.01))
    assert [r.ref for r in C.broken_balances(l, block).collect()] == ["#5(2025-01-05)"]


def test_scorecard(spark):
    i, c, l = inv(spark, {}, {"buyer_ban": "22099131"}), con(spark), led(spark)
    s = C.scorecard(C.findings(i, c, l, AS_OF), C.count_documents(i, c, l)).first()
    f = list(run(i, c, l).values())
    w = {"critical": 3, "warning": 1, "info": 0}
    assert float(s.integrity_score) == round(sum(w[r.severity] for r in f if r.passed) / sum(w[r.severity] for r in f), 3)
    assert s.critical_failures == sum(not r.passed and r.severity == "critical" for r in f) and not s.submission_ready


def twin(invoices, inflows):
    """First-fit in input order, references first."""
    used, got = set(), {}
    for n, i in enumerate(invoices):
        for k, l in enumerate(inflows):
            if k not in used and i["num"] and i["num"] == l["ref"]:
                used.add(k)
                got[n] = k
                break
    for n, i in enumerate(invoices):
        if n in got:
            continue
        anchor, win = (i["paid"], 5) if i["paid"] else (i["due"], 120)
        for k, l in enumerate(inflows):
            if k not in used and abs(l["amt"] - i["amt"]) <= 1 and (anchor is None or l["date"] is None or abs((l["date"] - anchor).days) <= win):
                used.add(k)
                got[n] = k
                break
    return {n + 1: got[n] + 1 if n in got else None for n in range(len(invoices))}


@pytest.mark.parametrize("seed,task_rows", [(0, 10_000), (1, 10_000), (2, 0), (3, 0), (4, 3)])
def test_reconciliation_equals_first_fit(spark, seed, task_rows):
    rnd = random.Random(seed)
    day = lambda: D(2025, 1, 1) + dt.timedelta(days=rnd.randrange(25 if seed % 2 else 300))
    invs = [dict(num=rnd.choice(["", f"N{rnd.randrange(12)}"]), amt=round(100 + rnd.choice([0, 0.5, 1, 1.7, 2.5, 50, 50.4]), 2), paid=rnd.choice([None, day(), day()]), due=rnd.choice([None, day()]) if seed == 1 else day()) for _ in range(60)]
    flows = [dict(ref=rnd.choice(["", f"N{rnd.randrange(12)}"]), amt=round(100 + rnd.choice([0, 0.5, 1, 1.7, 2.5, 50, 50.4]), 2), date=None if seed == 1 and rnd.random() < 0.1 else day()) for _ in range(50)]
    i = inv(spark, *[{"invoice_number": x["num"], "total_amount": x["amt"], "paid_date": x["paid"], "due_date": x["due"], "status": "paid"} for x in invs])
    l = led(spark, *[(x["date"], x["ref"], x["amt"], 0) for x in flows])
    got = {r.seq: r.l_seq for r in R.reconcile(i, l, task_rows=task_rows).collect()}
    assert got == twin(invs, flows)


def test_cells_of_equal_amounts_settle_in_few_rounds(spark, monkeypatch):
    """Thousands of equal fees on two days: whole cells pair at once, as first-fit would pair them."""
    n = 3000
    i = spark.range(1, n + 1).select(
        F.lit("T").alias("tenant_id"), F.col("id").alias("seq"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("invoice_number"), F.lit("PAID").alias("status"),
        F.lit(100).cast("decimal(18,2)").alias("total_amount"), F.expr("date '2024-01-01' + cast(if(id > 2000, 4, 0) as int)").alias("paid_date"), F.lit(None).cast("date").alias("due_date"))
    l = spark.range(1, n - 9).select(
        F.lit("T").alias("tenant_id"), F.col("id").alias("seq"), F.lit("").alias("reference"), F.lit(100.5).cast("decimal(18,2)").alias("amount"),
        F.expr("date '2024-01-01' + cast(if(id <= 1500, 5, 9) as int)").alias("txn_date"))
    seen = []
    real = R.cut
    monkeypatch.setattr(R, "cut", lambda df: seen.append(1) or real(df))
    got = {r.seq: r.l_seq for r in R.reconcile(i, l, task_rows=0).collect()}
    # the first day's invoices reach only the first day's inflows (5 days), the others both
    want = {k: k for k in range(1, 1501)} | {k: None for k in range(1501, 2001)} | {k: k - 500 for k in range(2001, n + 1)}
    want = {k: (v if v and v < n - 9 else None) for k, v in want.items()}
    assert got == want and len(seen) < 30
