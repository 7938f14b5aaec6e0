import datetime as dt
import random
import tempfile
from collections import defaultdict

from test_checks import con, inv
from tallyproof.operators import alerts as A
from tallyproof.streaming import monitor as M


def odd(spark, n=300, seed=3):
    r = random.Random(seed)
    day = lambda k=40: dt.date(2025, 1, 1) + dt.timedelta(days=r.randrange(k))
    return inv(spark, *[dict(tenant_id=f"T{r.randrange(9) ** 2 // 9}", buyer_ban=r.choice([None, "", *"abcdefgh"]), buyer_name=r.choice([None, "A", "B"]), total_amount=r.choice([None, -50, 0, 7, r.randrange(9), r.randrange(900)]),
                             status=r.choice([None, "PAID", "PAID", "PENDING", "VOID"]), paid_date=r.choice([None, day()]), due_date=r.choice([None, day()]), invoice_date=r.choice([None, day(200)])) for _ in range(n)],
               *[dict(tenant_id=f"U{k}", buyer_ban=f"u{j}", total_amount=10) for k in range(3) for j in range(1, 5 - k)])


def groups(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def test_narrowed_rules_lose_nothing(spark):
    i = odd(spark)
    rows = i.collect()
    pair, text = ("tenant_id", "buyer_name", "buyer_ban"), lambda found: sorted(map(str, found))
    opened = [r for r in rows if r.status in ("PENDING",)]
    total = {k: sum(r.total_amount or 0 for r in g) for k, g in groups(opened, "tenant_id").items()}
    want = [(*k, sum(r.total_amount for r in g if r.total_amount is not None)) for k, g in groups(opened, *pair).items() if any(r.total_amount is not None for r in g)]
    want = [w for w in want if total[(w[0],)] and w[3] * 100000 >= total[(w[0],)] * 39995]
    assert text(tuple(r[:4]) for r in A.open_share(i).collect()) == text(want) and want
    paid = groups([r for r in rows if r.status == "PAID" and r.paid_date and r.due_date], *pair)
    want = [(*k, sum(r.paid_date > r.due_date for r in g), len(g)) for k, g in paid.items()]
    want = [w for w in want if w[3] >= 2]
    assert text(tuple(r[:5]) for r in A.late_payers(i).collect()) == text(want) and want
    same = groups([r for r in rows if r.total_amount is not None and r.buyer_ban is not None], "tenant_id", "buyer_ban", "buyer_name", "total_amount")
    want = []
    for g in same.values():
        days = [r.invoice_date for r in g if r.invoice_date]
        if len(g) > 1 and days and (max(days) - min(days)).days <= 7:
            want += [r.seq for r in g]
    assert sorted(r.seq for r in A.repeated_billing(i).collect()) == sorted(want) and want


def test_changed_cases_are_broadcast(spark, monkeypatch):
    """The case tables are not shuffled to meet the cases of a batch."""
    seen, home = [], tempfile.mkdtemp(prefix="spark-")
    scan = A.scan
    monkeypatch.setattr(M.A, "scan", lambda i, c, day: seen.append(i._jdf.queryExecution().executedPlan().toString()) or scan(i, c, day))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        i = odd(spark, 40)
        i.select("tenant_id", "seq").write.parquet(f"{home}/in")
        changed = spark.readStream.schema("tenant_id string, seq long").parquet(f"{home}/in")
        M.alert_stream(changed, lambda: i, lambda: con(spark), M.AlertStore(spark, f"{home}/store"), dt.date(2025, 9, 1), f"{home}/p")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert seen and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in seen)
