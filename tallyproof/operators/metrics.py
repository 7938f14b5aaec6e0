"""Portfolio metrics, cash projection, what-if comparison and the case queue, for all cases at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import ids
from ..functions.ordered import chain, first_per_key, seq_block
from .checks import buyer_name

BUCKETS = ["current", "1-30", "31-60", "61-90", "over 90"]


def _total() -> Column:
    return F.coalesce("total_amount", F.lit(0))


def concentration(inv: DataFrame, top: int = 5) -> DataFrame:
    """Largest buyers per case with their share of the billed total."""
    b = inv.groupBy("tenant_id", buyer_name().alias("buyer")).agg(F.sum(_total()).alias("amount"), F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    t = b.groupBy("tenant_id").agg(F.sum("amount").alias("total_billed"), F.count("*").alias("buyer_count"), F.sum("n").alias("invoice_count"))
    k = first_per_key(b, ["tenant_id"], [F.desc("amount"), "first_seq"], top, rank="place")
    return k.join(t, "tenant_id").select(
        "tenant_id", "place", "buyer", "amount", ids.ratio(F.col("amount"), F.col("total_billed"), 4).alias("share"),
        "total_billed", "buyer_count", "invoice_count")


def ageing(inv: DataFrame, as_of: dt.date) -> DataFrame:
    """Open amount by age of the due date; all five buckets appear for every case, undated rows count as current."""
    days = F.coalesce(F.datediff(F.lit(as_of), "due_date"), F.lit(0))
    age = (F.when(days <= 0, BUCKETS[0]).when(days <= 30, BUCKETS[1]).when(days <= 60, BUCKETS[2])
           .when(days <= 90, BUCKETS[3]).otherwise(BUCKETS[4]))
    opened = ids.is_open(F.col("status"))
    pick = lambda b: opened & (age == b)
    g = inv.groupBy("tenant_id").agg(
        *[F.sum(F.when(pick(b), _total()).otherwise(0)).alias(f"a{i}") for i, b in enumerate(BUCKETS)],
        *[F.count_if(pick(b)).alias(f"n{i}") for i, b in enumerate(BUCKETS)],
        F.sum(F.when(F.upper("status") == "WRITTEN_OFF", _total()).otherwise(0)).alias("written_off"), F.sum(_total()).alias("billed"))
    open_total = sum((F.col(f"a{i}") for i in range(1, 5)), F.col("a0"))
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"a{i}").alias("amount"), F.col(f"n{i}").alias("n")) for i, b in enumerate(BUCKETS)])
    d = g.withColumn("open_total", open_total).withColumn("r", F.explode(rows))
    return d.select(
        "tenant_id", "r.bucket", "r.amount", "r.n", ids.ratio(F.col("r.amount"), F.col("open_total"), 4).alias("share"), "open_total",
        ids.ratio(F.col("open_total") - F.col("a0"), F.col("open_total"), 4).alias("overdue_ratio"),
        ids.ratio(F.col("written_off"), F.col("billed"), 4).alias("written_off_ratio"))


def summary(inv: DataFrame) -> DataFrame:
    opened = ids.is_open(F.col("status"))
    terms = F.when(F.col("payment_terms_days") != 0, F.col("payment_terms_days"))
    return inv.groupBy("tenant_id").agg(
        F.sum(_total()).alias("billed_total"), F.sum(F.when(opened, _total()).otherwise(0)).alias("open_total"),
        F.count("*").alias("invoice_count"), F.count_if(opened).alias("open_count"),
        F.round(F.coalesce(F.avg(terms), F.lit(0.0)), 1).alias("avg_terms_days"),
        F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date"))


def opening_balance(led: DataFrame) -> DataFrame:
    """Balance of the last ledger row in input order."""
    return led.where("balance is not null").groupBy("tenant_id").agg(F.max_by("balance", "seq").alias("opening"))


def cash_events(inv: DataFrame, bil: DataFrame, as_of: dt.date, horizon: int = 90, opex: DataFrame | None = None) -> DataFrame:
    """Dated in- and outflows of the horizon: running costs on the 5th of each month, pending receivables, pending bills."""
    until = as_of + dt.timedelta(days=horizon)
    inside = F.col("due_date").between(F.lit(as_of), F.lit(until)) & (F.col("status") == "PENDING")
    e = inv.where(inside).select("tenant_id", F.col("due_date").alias("d"), F.lit(1).alias("kind"), "seq", _total().alias("amount"),
                                 F.col("buyer_name").alias("counterparty"), F.col("invoice_number").alias("reference"))
    e = e.unionByName(bil.where(inside).select(
        "tenant_id", F.col("due_date").alias("d"), F.lit(2).alias("kind"), "seq", (-F.col("amount")).alias("amount"),
        F.col("supplier_name").alias("counterparty"), F.col("bill_number").alias("reference")))
    if opex is not None:
        first = dt.date(as_of.year, as_of.month, 5)
        months = F.sequence(F.lit(first), F.lit(until), F.expr("interval 1 month"))
        o = opex.where("monthly_opex <> 0").withColumn("d", F.explode(months)).where(F.col("d").between(F.lit(as_of), F.lit(until)))
        e = e.unionByName(o.select("tenant_id", "d", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("seq"),
                                   (-F.col("monthly_opex")).cast("decimal(18,2)").alias("amount"), F.lit("operating costs").alias("counterparty"), F.lit("").alias("reference")))
    return e


EVENT_ORDER = ["d", "kind", "seq", "reference"]


def cash_timeline(events: DataFrame, opening: DataFrame, keys: list[str] = ["tenant_id"]) -> DataFrame:
    """Running balance after every event, in date order."""
    e = chain(events, keys, {"day": F.col("d"), "kind": F.col("kind"), "range": seq_block()}, EVENT_ORDER, sums={"run": F.col("amount")})
    e = e.join(opening, "tenant_id", "left")
    return e.withColumn("balance", F.coalesce("opening", F.lit(0)) + F.col("run")).drop("run", "opening")


def cash_gap(timeline: DataFrame, opening: DataFrame, overdue: DataFrame, keys: list[str] = ["tenant_id"]) -> DataFrame:
    """First date below zero, the lowest balance and when it is first reached."""
    at = F.struct(*EVENT_ORDER)
    neg = F.when(F.col("balance") < 0, at)
    g = timeline.groupBy(*keys).agg(
        F.count("*").alias("n_events"), F.min(neg)["d"].alias("gap_date"), F.min_by("balance", neg).alias("gap_amount"),
        F.min("balance").alias("trough"), F.min_by("d", F.struct("balance", *EVENT_ORDER)).alias("trough_date"))
    return g.join(opening, "tenant_id", "left").join(overdue, "tenant_id", "left").select(
        *keys, F.coalesce("opening", F.lit(0)).alias("opening"), "n_events", F.col("gap_date").isNotNull().alias("gap_detected"),
        "gap_date", "gap_amount", "trough", "trough_date", F.coalesce("overdue_total", F.lit(0)).alias("overdue_total"))


def overdue_total(inv: DataFrame) -> DataFrame:
    return inv.groupBy("tenant_id").agg(F.sum(F.when(F.col("status") == "OVERDUE", _total()).otherwise(0)).alias("overdue_total"))


def what_if(events: DataFrame, opening: DataFrame, cases: DataFrame, as_of: dt.date, scenarios: list[tuple[float, int]]) -> DataFrame:
    """Add one hypothetical bill (amount, days from ``as_of``) per scenario and compare the lowest balances."""
    arr = F.array(*[F.struct(F.lit(i + 1).alias("scenario"), F.lit(a).cast("decimal(18,2)").alias("amount"),
                             F.lit(as_of + dt.timedelta(days=n)).alias("d")) for i, (a, n) in enumerate(scenarios)])
    sims = cases.select("tenant_id", F.explode(arr).alias("s")).select("tenant_id", "s.*")
    ids_ = F.array(*[F.lit(i) for i in range(len(scenarios) + 1)])
    base = events.withColumn("scenario", F.explode(ids_))
    bill = sims.select("tenant_id", "d", F.lit(3).alias("kind"), F.lit(0).cast("bigint").alias("seq"), (-F.col("amount")).alias("amount"),
                       F.lit("hypothetical bill").alias("counterparty"), F.lit("SIM-WHATIF").alias("reference"), "scenario")
    t = cash_timeline(base.unionByName(bill), opening, ["tenant_id", "scenario"])
    g = t.groupBy("tenant_id", "scenario").agg(F.min("balance").alias("trough"), F.min_by("d", F.struct("balance", *EVENT_ORDER)).alias("trough_date"))
    b = g.where("scenario = 0").select("tenant_id", F.col("trough").alias("base_trough"))
    d = (g.where("scenario > 0").join(b, "tenant_id", "left").join(opening, "tenant_id", "left")
         .withColumn("base_trough", F.coalesce("base_trough", "opening", F.lit(0))))
    drop = F.col("base_trough") - F.col("trough")
    turns = (F.col("base_trough") >= 0) & (F.col("trough") < 0)
    return d.select("tenant_id", "scenario", "base_trough", "trough", "trough_date", drop.alias("trough_drop"), turns.alias("turns_negative"),
                    F.when(turns, "turns negative").when(drop != 0, "lower trough").otherwise("no effect").alias("verdict"))


def inflow_timeline(inv: DataFrame, led: DataFrame) -> DataFrame:
    """Open inflow per due date, running balance from the latest ledger balance minus the mean outflow of its last 90 days."""
    g = inv.where(ids.is_open_strict(F.col("status")) & F.col("due_date").isNotNull()).groupBy("tenant_id", F.col("due_date").alias("d")).agg(
        F.sum("total_amount").alias("inflow"), F.count("*").alias("n"))
    last = led.groupBy("tenant_id").agg(
        F.max_by("balance", F.when(F.col("balance").isNotNull(), F.struct("txn_date", "seq"))).alias("opening"), F.max("txn_date").alias("last_date"))
    out = led.where("amount < 0").join(last.select("tenant_id", "last_date"), "tenant_id").where(
        F.col("txn_date") >= F.date_sub("last_date", 90)).groupBy("tenant_id").agg((F.abs(F.sum("amount")).cast("double") / 90).alias("daily_outflow"))
    # One row per day is left here, so a case has at most as many rows as there are days.
    w = W.partitionBy("tenant_id").orderBy("d")
    d = g.withColumn("run", F.sum("inflow").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("first_d", F.min("d").over(w))
    d = d.join(last, "tenant_id", "left").join(out, "tenant_id", "left")
    bal = (F.coalesce(F.col("opening"), F.lit(0)) + F.col("run")).cast("double") - F.coalesce("daily_outflow", F.lit(0.0)) * F.datediff("d", "first_d")
    return d.select("tenant_id", "d", "inflow", "n", F.round(bal, 0).alias("balance"))


def case_queue(cases: DataFrame, alerts: DataFrame, as_of: dt.date) -> DataFrame:
    """Open cases by traffic light, oldest intake first. ``place`` states the order without a global sort."""
    sev = lambda s: F.count_if(F.col("severity") == s)
    a = alerts.where("resolved_at is null").groupBy("tenant_id").agg(sev("critical").alias("n_critical"), sev("warning").alias("n_warning"), sev("info").alias("n_info"))
    d = cases.where("tenant_id <> 'SHARED'").join(a, "tenant_id", "left").na.fill(0, ["n_critical", "n_warning", "n_info"])
    light = F.when(F.col("n_critical") > 0, "critical").when(F.col("n_warning") > 0, "warning").otherwise("good")
    rank = F.when(F.col("n_critical") > 0, 0).when(F.col("n_warning") > 0, 1).otherwise(2)
    return d.select("tenant_id", "client_name", "created_on", F.datediff(F.lit(as_of), "created_on").alias("ageing_days"),
                    light.alias("light"), rank.alias("light_rank"), "n_critical", "n_warning", "n_info")


def lookup_evidence(refs: DataFrame, inv: DataFrame, con: DataFrame, led: DataFrame, fallback_rows: int = 5) -> DataFrame:
    """Rows behind (tenant_id, ref): invoice, contract or ledger row with that id, else up to five invoices of that party."""
    refs = refs.where(F.coalesce("ref", F.lit("")) != "").distinct()
    i = inv.select("tenant_id", F.col("invoice_number").alias("ref"), F.lit("invoice").alias("kind"), "seq", F.col("total_amount").alias("amount"))
    c = con.select("tenant_id", F.col("contract_number").alias("ref"), F.lit("contract").alias("kind"), "seq", F.col("annual_commitment_amount").alias("amount"))
    l = led.select("tenant_id", F.col("reference").alias("ref"), F.lit("ledger").alias("kind"), "seq", "amount")
    found = refs.join(i.unionByName(c).unionByName(l), ["tenant_id", "ref"])
    rest = refs.join(found.select("tenant_id", "ref").distinct(), ["tenant_id", "ref"], "left_anti")
    party = inv.select("tenant_id", "seq", F.col("total_amount").alias("amount"), F.explode(F.array_distinct(F.array("buyer_ban", "seller_ban"))).alias("ref"))
    by_party = first_per_key(rest.join(party, ["tenant_id", "ref"]), ["tenant_id", "ref"], ["seq"], fallback_rows)
    return found.unionByName(by_party.withColumn("kind", F.lit("invoice by party")))


def retention(cases: DataFrame, years: int = 5, as_of: dt.date | None = None) -> DataFrame:
    """Keep-until date per case; with ``as_of`` also whether it has passed."""
    d = cases.withColumn("keep_until", F.add_months("created_on", 12 * years))
    if as_of is not None:
        d = d.withColumn("expired", F.col("keep_until") < F.lit(as_of))
    return d


def stale(source_date: Column, as_of: dt.date, days: int = 90) -> Column:
    return F.datediff(F.lit(as_of), source_date) > days


def positive_number(c: Column) -> Column:
    """True for real numbers above zero; NaN and NULL are not."""
    return F.coalesce(~F.isnan(c) & (c > 0), F.lit(False))
