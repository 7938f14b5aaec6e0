import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from test_checks import AS_OF, con, inv, led
from tallyproof.operators import checks as C, reconcile as R
from tallyproof.sources import driver_tables as D


def rows(found):
    return sorted((r.tenant_id, r.check_id, r.severity, r.passed, r.n_flagged) for r in found.select("tenant_id", "check_id", "severity", "passed", "n_flagged").collect())


def alike(i, c, l, as_of, checks=tuple(C.CHECKS)):
    got = C.findings(i, c, l, as_of, C.Verdicts(checks))
    assert not {"refs", "measure"} & set(got.columns)
    assert rows(got) == rows(C.findings(i, c, l, as_of, checks))


def test_verdicts_equal_findings_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    alike(D.invoices(spark, sf), D.contracts(spark, sf), D.ledger(spark, sf), D.AS_OF)


@pytest.mark.parametrize("seed", [1])
def test_verdicts_equal_findings_on_odd_rows(spark, seed):
    r = random.Random(seed)
    bans = ["22099131", "04595257", "2209-9131", "", None, "123", "87654321"]
    day = lambda: dt.date(2025, 1, 1) + dt.timedelta(days=r.randrange(420))
    some = lambda *x: r.choice(x)
    i = inv(spark, *[dict(tenant_id=some("T", "T", "U", "V", "W"), seq=k, invoice_number=some(None, "", f"AB{r.randrange(30):08d}", f"AB{r.randrange(30):08d}", f"{'9' * 20}{k}"),
                          invoice_date=some(None, day(), day()), due_date=some(None, day()), paid_date=some(None, day()), seller_ban=some(*bans), buyer_ban=some(*bans),
                          buyer_name=some(None, "", "A", "B", "C"), sales_amount=some(None, -5, 0, 20000, r.randrange(9000)), tax_amount=some(None, -1, 450),
                          total_amount=some(None, -3, 0, 9, 60_000_000, r.randrange(400), r.randrange(90000)), payment_terms_days=some(None, 30, 60),
                          status=some(None, "PAID", "paid", "PENDING", "WRITTEN_OFF", "VOID")) for k in range(260)],
            dict(tenant_id="X", seq=900, total_amount=0, buyer_name="A"), dict(tenant_id="Y", seq=901, total_amount=-5))
    c = con(spark, *[dict(tenant_id=some("T", "U", "Z"), seq=k, buyer_ban=some(*bans), payment_terms_days=some(None, 30, 90), effective_date=some(None, day()),
                          annual_commitment_amount=some(0, None, -50, 100, 90000)) for k in range(14)])
    l = led(spark, *[(some(None, day()), some("", None, f"AB{r.randrange(30):08d}"), some(None, -4, 9, r.randrange(400)), some(None, 50, 100)) for _ in range(80)])
    l = l.withColumn("tenant_id", F.when(F.col("seq") % 3 == 0, "U").otherwise(F.col("tenant_id")))
    alike(i, c, l, AS_OF)
    alike(i, None, None, AS_OF, ["TAXID-01", "DUP-01", "DUP-02", "RISK-01", "FORENSIC-03"])
    left = R.reconcile(i, l).where("how = 'none'").groupBy("tenant_id").count().collect()
    assert {(t, n) for t, n in left} == {(t, n) for t, n in R.open_counts(i, l).where("n_open > 0").collect()}


def test_numbers_are_padded_as_by_printf(spark):
    n = [0, 7, 9999, 10_000, 123_456, -3]
    d = spark.createDataFrame([(x,) for x in n], "n long")
    assert [x.c for x in d.select(D._case(F.col("n")).alias("c")).collect()] == [f"CASE-{x:04d}" for x in n]
