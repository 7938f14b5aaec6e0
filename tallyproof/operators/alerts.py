"""Monitoring rules over all cases, alert headers with fingerprints, and the alert store.

A rule returns its *evidence rows*. They stay a table: a header per (case, rule) carries count, amount and a
fingerprint that is a multiset hash of the evidence (count, sum and xor of row digests), so no evidence list is ever
gathered in one place and the order of rows does not matter.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids
from ..functions.joins import broadcast_if_small
from ..session import cut

DUE_SOON_DAYS, CONCENTRATION_PCT, TERMS_TOLERANCE, LATE_COUNT, DSO_MIN_N, DSO_CHANGE, DUP_DAYS = 7, 40, 3, 2, 10, 15.0, 7
EVIDENCE = ["tenant_id", "rule_id", "severity", "key", "amount", "days"]
#: Rows of short keys that may be broadcast to pick rows of a case table.
KEYS = 1_000_000


def _several(d: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(_h): hashes of the keys that stand ``least`` times in ``d``, and now and then of others. Eight bytes of a row are shuffled."""
    n = d.groupBy(F.xxhash64(*keys).alias("_h")).agg(F.count("*").alias("n"))
    return broadcast_if_small(cut(n.where(F.col("n") >= least).select("_h")), KEYS)


def _of(d: DataFrame, keys: list[str], hashes: DataFrame) -> DataFrame:
    """Rows that may be of those keys; the others are not shuffled."""
    return d.withColumn("_h", F.xxhash64(*keys)).join(hashes, "_h", "left_semi").drop("_h")


def _open(inv: DataFrame) -> DataFrame:
    return inv.where(ids.is_open_strict(F.col("status")))


def due_soon(inv: DataFrame, today: dt.date) -> DataFrame:
    until = today + dt.timedelta(days=DUE_SOON_DAYS)
    return _open(inv).where(F.col("due_date").between(F.lit(today), F.lit(until))).select(
        "tenant_id", "seq", "invoice_number", "buyer_name", "buyer_ban", "due_date", "total_amount")


def overdue(inv: DataFrame, today: dt.date) -> DataFrame:
    return _open(inv).where(F.col("due_date") < F.lit(today)).select(
        "tenant_id", "seq", "invoice_number", "buyer_name", "buyer_ban", "due_date", "total_amount",
        F.datediff(F.lit(today), "due_date").alias("days_overdue"))


def _large_buyers(opened: DataFrame, buckets: int = 16) -> DataFrame:
    """Rows of the cases in which some buyer may hold ``CONCENTRATION_PCT``. A buyer holds no more than the positive amounts of its bucket."""
    d = opened.select("tenant_id", F.pmod(F.xxhash64("buyer_name", "buyer_ban"), F.lit(buckets)).alias("b"), F.coalesce("total_amount", F.lit(0)).alias("amt"))
    g = d.groupBy("tenant_id", "b").agg(F.sum("amt").alias("amt"), F.sum(F.greatest("amt", F.lit(0))).alias("most"))
    t = g.groupBy("tenant_id").agg(F.sum("amt").cast("double").alias("amt"), F.max("most").cast("double").alias("most"))
    maybe = cut(t.where(f"amt <= 0 or {100.1 / (CONCENTRATION_PCT - 0.1)} * most >= amt").select("tenant_id"))
    return opened.join(broadcast_if_small(maybe, KEYS), "tenant_id", "left_semi")


def open_share(inv: DataFrame) -> DataFrame:
    """Buyers holding at least 40.00 percent (two decimals, inclusive) of a case's open amount."""
    d = _large_buyers(_open(inv))
    b = d.groupBy("tenant_id", "buyer_name", "buyer_ban").agg(F.sum("total_amount").alias("amt"))
    t = b.groupBy("tenant_id").agg(F.sum("amt").alias("total"))
    d = b.join(t, "tenant_id").where(F.col("total") != 0)
    # round(100 a / t, 2) >= 40.00 without leaving decimals
    d = d.where(F.col("amt") * 100000 >= F.col("total") * (CONCENTRATION_PCT * 1000 - 5))
    return d.select("tenant_id", "buyer_name", "buyer_ban", "amt", F.round(100 * F.col("amt").cast("double") / F.col("total").cast("double"), 2).alias("pct"))


def terms_mismatch(inv: DataFrame, con: DataFrame) -> DataFrame:
    """Invoice terms off by more than three days from a contract valid on the invoice date (one row per such contract)."""
    c = con.where("payment_terms_days is not null").select(
        "tenant_id", "buyer_ban", "contract_number", F.col("payment_terms_days").alias("contract_terms"), "effective_date", "expiry_date")
    d = inv.where("payment_terms_days is not null").join(c, ["tenant_id", "buyer_ban"])
    d = d.where((F.col("effective_date").isNull() | (F.col("invoice_date") >= F.col("effective_date")))
                & (F.col("expiry_date").isNull() | (F.col("invoice_date") <= F.col("expiry_date"))))
    diff = F.col("payment_terms_days") - F.col("contract_terms")
    return d.where(F.abs(diff) > TERMS_TOLERANCE).select(
        "tenant_id", "seq", "invoice_number", "buyer_name", "buyer_ban", "contract_number",
        F.col("payment_terms_days").alias("invoice_terms"), "contract_terms", diff.alias("diff_days"), "invoice_date", "total_amount")


def late_payers(inv: DataFrame) -> DataFrame:
    keys = ["tenant_id", "buyer_name", "buyer_ban"]
    paid = inv.where("status = 'PAID' and paid_date is not null and due_date is not null")
    d = _of(paid, keys, _several(paid.where("paid_date > due_date"), keys, LATE_COUNT)).groupBy(*keys).agg(
        F.count_if(F.col("paid_date") > F.col("due_date")).alias("late_cnt"), F.count("*").alias("paid_cnt"),
        F.max(F.datediff("paid_date", "due_date")).alias("worst_delay"))
    return d.where(F.col("late_cnt") >= LATE_COUNT)


def collection_slowdown(inv: DataFrame, today: dt.date) -> DataFrame:
    """Mean days from invoice to payment, last 90 days against the 90 before."""
    p, days = F.col("paid_date"), F.datediff("paid_date", "invoice_date")
    recent = p >= F.lit(today - dt.timedelta(days=90))
    prior = (p >= F.lit(today - dt.timedelta(days=180))) & (p < F.lit(today - dt.timedelta(days=90)))
    g = inv.where("status = 'PAID' and paid_date is not null and invoice_date is not null").groupBy("tenant_id").agg(
        F.avg(F.when(recent, days)).alias("r"), F.avg(F.when(prior, days)).alias("p"), F.count_if(recent).alias("n_recent"))
    change = 100 * (F.col("r") - F.col("p")) / F.col("p")
    d = g.where((F.col("n_recent") >= DSO_MIN_N) & (F.col("p") > 0)).withColumn("c", change).where(F.col("c") >= DSO_CHANGE)
    return d.select("tenant_id", F.round("r", 1).alias("recent_dso"), F.round("p", 1).alias("prior_dso"), F.round("c", 1).alias("change_pct"), "n_recent")


def repeated_billing(inv: DataFrame) -> DataFrame:
    """Invoices of groups with equal buyer and amount, issued within seven days over the whole group. One row per invoice."""
    keys = ["tenant_id", "buyer_ban", "buyer_name", "total_amount"]
    d = inv.dropna(subset=["total_amount", "buyer_ban"])
    d = _of(d, keys, _several(d, keys))
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.datediff(F.max("invoice_date"), F.min("invoice_date")).alias("spread"))
    g = g.where((F.col("n") > 1) & (F.col("spread") <= DUP_DAYS)).withColumnRenamed("buyer_name", "_bn")
    j = d.join(g.select("tenant_id", "buyer_ban", "_bn", "total_amount", "n", "spread"), ["tenant_id", "buyer_ban", "total_amount"])
    return j.where(F.col("buyer_name").eqNullSafe(F.col("_bn"))).select(*keys, "n", "spread", "invoice_number", "invoice_date", "seq")


def _evidence(d: DataFrame, rule: str, severity: Column | str, key: list, amount: Column, days: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    text = F.concat_ws("|", *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in key])
    return d.select("tenant_id", F.lit(rule).alias("rule_id"), sev.alias("severity"), text.alias("key"),
                    amount.cast("decimal(38,2)").alias("amount"), days.cast("bigint").alias("days"))


# Rule registry: id -> function(inv, con, today) giving evidence rows. Ageing numbers stay out of the key.
RULES = {
    "WATCH-01": lambda inv, con, today: _evidence(due_soon(inv, today), "WATCH-01", "info", ["invoice_number", "buyer_ban", "due_date", "total_amount"], F.col("total_amount"), F.lit(0)),
    "WATCH-02": lambda inv, con, today: _evidence(overdue(inv, today), "WATCH-02", "warning", ["invoice_number", "buyer_ban", "due_date", "total_amount"], F.col("total_amount"), F.col("days_overdue")),
    "WATCH-03": lambda inv, con, today: _evidence(open_share(inv), "WATCH-03", "warning", ["buyer_ban", F.col("amt").cast("decimal(18,2)")], F.col("amt"), F.lit(0)),
    "WATCH-04": lambda inv, con, today: _evidence(terms_mismatch(inv, con), "WATCH-04", "warning", ["invoice_number", "buyer_ban", "contract_number", "invoice_terms", "contract_terms"], F.col("total_amount"), F.col("diff_days")),
    "WATCH-05": lambda inv, con, today: _evidence(late_payers(inv), "WATCH-05", "warning", ["buyer_ban", "buyer_name", "late_cnt", "paid_cnt", "worst_delay"], F.lit(0), F.col("worst_delay")),
    "WATCH-06": lambda inv, con, today: _evidence(collection_slowdown(inv, today), "WATCH-06", "warning", ["n_recent", F.format_string("%.1f", F.col("recent_dso"))], F.lit(0), F.lit(0)),
    "WATCH-07": lambda inv, con, today: _evidence(repeated_billing(inv), "WATCH-07", "warning", ["buyer_ban", "total_amount", "invoice_number", "invoice_date"], F.col("total_amount"), F.lit(0)),
}


def headers(evidence: DataFrame) -> DataFrame:
    """One alert per (case, rule) with a fingerprint over its evidence, whatever the row order."""
    h = F.conv(F.substring(F.md5(F.concat_ws("#", "rule_id", "key")), 1, 15), 16, 10).cast("bigint")
    g = evidence.withColumn("h", h).groupBy("tenant_id", "rule_id").agg(
        F.max("severity").alias("severity"), F.count("*").alias("n_evidence"), F.sum("amount").alias("amount"), F.max("days").alias("worst_days"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"), F.min_by("key", F.struct("key")).alias("first_key"))
    fp = F.substring(F.sha2(F.concat_ws("|", "rule_id", "n_evidence", "s", "x"), 256), 1, 32)
    sev = F.when((F.col("rule_id") == "WATCH-02") & (F.col("worst_days") >= 90), "critical").otherwise(F.col("severity"))
    return g.select("tenant_id", "rule_id", sev.alias("severity"), "n_evidence", "amount", "worst_days", "first_key", fp.alias("fingerprint"))


def scan(inv: DataFrame, con: DataFrame, today: dt.date, rules: dict | None = None, isolate: bool = False) -> DataFrame:
    """Alert headers of all rules. With ``isolate`` each rule runs on its own and one that fails becomes a critical
    alert (case ``*``) in place of stopping the scan; a rule that cannot even be planned always does."""
    parts = []
    for rule, fn in (rules or RULES).items():
        try:
            h = headers(fn(inv, con, today))
            parts.append(cut(h) if isolate else h)
        except Exception as e:  # the failure itself is the alert
            failed = isinstance(e, (Py4JJavaError, PySparkException)) and not isinstance(e, AnalysisException)
            if failed and not isolate:  # planned, but a job of it broke
                raise
            msg = f"rule failed: {type(e).__name__}"
            parts.append(inv.sparkSession.range(1).select(
                F.lit("*").alias("tenant_id"), F.lit(rule).alias("rule_id"), F.lit("critical").alias("severity"), F.lit(0).cast("bigint").alias("n_evidence"),
                F.lit(0).cast("decimal(38,2)").alias("amount"), F.lit(None).cast("bigint").alias("worst_days"), F.lit(msg).alias("first_key"),
                F.substring(F.sha2(F.lit(rule + msg), 256), 1, 32).alias("fingerprint")))
    return reduce(DataFrame.unionByName, parts)


def severity_rank(c: str | Column = "severity") -> Column:
    s = F.col(c) if isinstance(c, str) else c
    return F.when(s == "critical", 0).when(s == "warning", 1).otherwise(2)


STORE = ["tenant_id", "fingerprint", "rule_id", "severity", "n_evidence", "first_seen_at", "last_seen_at", "resolved_at"]


def upsert(store: DataFrame, batch: DataFrame, seen_at: Column) -> DataFrame:
    """New fingerprints enter the store; a known one only moves its last-seen time forward."""
    b = batch.groupBy("tenant_id", "fingerprint").agg(F.min("rule_id").alias("b_rule"), F.min("severity").alias("b_sev"), F.min("n_evidence").alias("b_n"))
    d = store.join(b, ["tenant_id", "fingerprint"], "full_outer")
    fresh = F.when(F.col("b_rule").isNotNull(), seen_at)
    return d.select(
        "tenant_id", "fingerprint", F.coalesce("rule_id", "b_rule").alias("rule_id"), F.coalesce("severity", "b_sev").alias("severity"),
        F.coalesce("n_evidence", "b_n").alias("n_evidence"), F.coalesce("first_seen_at", fresh).alias("first_seen_at"),
        F.greatest("last_seen_at", fresh).alias("last_seen_at"), "resolved_at")


def open_alerts(store: DataFrame) -> DataFrame:
    """Unresolved alerts, most severe first, newest first within a severity."""
    return store.where("resolved_at is null").orderBy(severity_rank(), F.desc("first_seen_at"), "tenant_id", "fingerprint")
