"""Verdicts of all checks per case: passed or not and how many are flagged, without the references and measures of a report.

Without references no violation needs a row of its own. Row-level rules are counted in one aggregate by case; what compares rows is first
narrowed by an aggregate that holds little (counts by hash, by amount range, by buyer bucket), and only rows that can matter are compared in full.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import ids
from ..functions.joins import broadcast_if_small
from ..functions.ordered import chain, seq_block
from ..session import cut
from . import checks as C
from .reconcile import open_counts

#: Rows of short keys that may be broadcast to pick rows of a case table.
KEYS = 1_000_000
PAIR = ["tenant_id", "_buyer"]


def _amount() -> Column:
    return F.coalesce("total_amount", F.lit(0))


def case_counts(inv: DataFrame, as_of: dt.date, want: set[str]) -> DataFrame:
    """The profile of each case and how often its invoices break each row-level rule (n_<check>), in one aggregate."""
    d = inv.withColumns({"_seller": ids.clean_ban(F.col("seller_ban")), "_clean": ids.clean_ban(F.col("buyer_ban"))})
    rules = {k: v for k, v in C.row_rules(as_of).items() if k in want and k not in C.LISTED}
    broken = [reduce(lambda a, b: a + b, [F.count_if(c) for c in conds]).alias(f"n_{k}") for k, conds in rules.items()]
    return C.profile(d, as_of, broken)


def threshold(inv: DataFrame, cases: DataFrame, block: int = 1000) -> DataFrame:
    """``checks.large_threshold`` of ``cases``. Counts by ranges of amounts say which range holds the position; only its amounts are put in order."""
    a = inv.select("tenant_id", _amount().alias("amt"))
    x = F.col("amt").cast("double")
    a = a.withColumn("range", F.floor(F.signum(x) * F.log1p(F.abs(x)) * 8))
    w = W.partitionBy("tenant_id")
    hist = a.groupBy("tenant_id", "range").agg(F.count("*").alias("n")).select(
        "*", F.sum("n").over(w.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, W.currentRow)).alias("upto"), F.sum("n").over(w).alias("all"))
    k = F.greatest(F.lit(1), F.floor(F.col("all") / 4))
    pick = hist.where((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select("tenant_id", "range", (k - F.col("upto") + F.col("n")).alias("k")).join(cases, "tenant_id", "left_semi")
    held = a.join(broadcast_if_small(cut(pick), KEYS), ["tenant_id", "range"]).groupBy("tenant_id", "amt", "k").agg(F.count("*").alias("n"))
    held = cut(held.withColumn("neg", -F.col("amt")))
    held = chain(held, ["tenant_id"], {"range": F.floor(F.col("neg") / block)}, ["neg"], sums={"upto": F.col("n")})
    return held.where("upto >= k").groupBy("tenant_id").agg(F.max("amt").alias("threshold"))


def pair_counts(inv: DataFrame, con: DataFrame | None, want: set[str]) -> DataFrame:
    """(case, buyer) pairs that say something: broken contract rules, several invoices, or billing that may pass the commitment.

    Invoices meet the last contract of their pair once, for all rules."""
    i = inv.select("tenant_id", F.coalesce(ids.clean_ban(F.col("buyer_ban")), F.lit("")).alias("_buyer"), "payment_terms_days", "invoice_date", _amount().alias("amt"))
    if con is None:
        return cut(i.groupBy(*PAIR).agg(F.count("*").alias("n")).where("n > 1"))
    if "CONTRACT-01" in want:
        t = broadcast_if_small(cut(threshold(inv, con.select("tenant_id").distinct())), KEYS)
        i = i.join(t, "tenant_id", "left").withColumn("big", F.coalesce(F.col("amt") >= F.col("threshold"), F.lit(False))).drop("threshold")
    else:
        i = i.withColumn("big", F.lit(False))
    c = C.last_contract(con).withColumn("_buyer", F.coalesce("_buyer", F.lit("")))
    g = i.join(c, PAIR, "left").groupBy(*PAIR).agg(
        F.count("*").alias("n"), F.count_if(F.col("c_found") & (F.col("payment_terms_days") != F.col("c_terms"))).alias("n_TERM-02"),
        F.count_if(F.col("c_found") & (F.col("invoice_date") < F.col("c_start"))).alias("n_TERM-03"), F.count_if(F.col("c_found").isNull() & F.col("big")).alias("n_CONTRACT-01"),
        F.sum(F.greatest("amt", F.lit(0))).alias("most"), F.max("c_commit").alias("commit"))
    over = (F.col("commit") != 0) & ((F.col("most") > 2 * F.col("commit")) | (F.col("commit") < 0))
    g = g.withColumn("commit", F.when(over, F.col("commit"))).drop("most")
    return cut(g.where((F.col("n") > 1) | (F.col("n_TERM-02") > 0) | (F.col("n_TERM-03") > 0) | (F.col("n_CONTRACT-01") > 0) | F.col("commit").isNotNull()))


def duplicate_numbers(inv: DataFrame) -> DataFrame:
    """DUP-01: numbers are counted by a hash; only those whose hash comes up again are compared."""
    h = F.xxhash64("tenant_id", C._number())
    again = broadcast_if_small(cut(inv.groupBy(h.alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h")), KEYS)
    return C.duplicate_numbers(inv.select("tenant_id", "seq", "invoice_number", h.alias("h")).join(again, "h", "left_semi"))


def dominated(inv: DataFrame, buckets: int = 16) -> DataFrame:
    """RISK-01: cases whose largest buyer holds half of the billing. A buyer holds no more than the positive amounts of its bucket, so
    buyers are summed only in cases where some bucket reaches half."""
    d = inv.select("tenant_id", F.pmod(F.xxhash64(C.buyer_name()), F.lit(buckets)).alias("b"), _amount().alias("amt"))
    g = d.groupBy("tenant_id", "b").agg(F.sum("amt").alias("amt"), F.sum(F.greatest("amt", F.lit(0))).alias("most"))
    t = g.groupBy("tenant_id").agg(F.sum("amt").cast("double").alias("amt"), F.max("most").cast("double").alias("most"))
    maybe = broadcast_if_small(cut(t.where("amt <= 0 or 2.001 * most >= amt").select("tenant_id")), KEYS)
    return C.top_buyer(inv.join(maybe, "tenant_id", "left_semi")).where("share >= 0.5").select("tenant_id", F.lit(1).cast("bigint").alias("n_RISK-01"))


def verdicts(inv: DataFrame, con: DataFrame | None, led: DataFrame | None, as_of: dt.date, checks: list[str]) -> DataFrame:
    """(tenant_id, check_id, severity, passed, n_flagged) of the checks, equal to those columns of ``checks.findings``."""
    want = set(checks)
    by_case = lambda d, k: d.groupBy("tenant_id").agg(F.count("*").alias(f"n_{k}"))
    parts = []
    if con is not None:
        parts.append(by_case(con, "contracts"))
    if led is not None:
        parts.append(by_case(led, "ledger"))
    contract = want & set(C.NEED_CONTRACT)
    if contract or want & {"DUP-02", "SEQ-01"}:
        pairs = pair_counts(inv, con if contract else None, want)
        if contract:
            parts.append(pairs.groupBy("tenant_id").agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in ("TERM-02", "TERM-03", "CONTRACT-01")]))
        near = pairs.where("n > 1 or commit is not null" if contract else "n > 1").select(*PAIR, "n", *(["commit"] if contract else []))
        rows = inv.select("tenant_id", F.coalesce(ids.clean_ban(F.col("buyer_ban")), F.lit("")).alias("_buyer"), "buyer_ban", "seq", "invoice_number", "total_amount", "invoice_date")
        rows = cut(rows.join(broadcast_if_small(near, KEYS), PAIR))
        if "DUP-02" in want:
            parts.append(by_case(C.duplicate_claims(rows), "DUP-02"))
        if "SEQ-01" in want:
            parts.append(by_case(C.consecutive_runs(rows), "SEQ-01"))
        if "CONTRACT-02" in want:
            d = chain(rows.where("commit is not null").select(*PAIR, "seq", _amount().alias("amt"), "commit"), PAIR, {"range": seq_block()}, ["seq"], sums={"acc": F.col("amt")})
            parts.append(by_case(d.where(F.col("acc") > 2 * F.col("commit")).select(*PAIR).distinct(), "CONTRACT-02"))
    if "DUP-01" in want:
        parts.append(by_case(duplicate_numbers(inv), "DUP-01"))
    if "LEDGER-01" in want:
        parts.append(by_case(C.broken_balances(led), "LEDGER-01"))
    if "BANK-01" in want:
        parts.append(open_counts(inv, led).withColumnRenamed("n_open", "n_BANK-01"))
    if "RISK-01" in want:
        parts.append(dominated(inv))
    wide = reduce(lambda a, b: a.join(b, "tenant_id", "left"), parts, case_counts(inv, as_of, want))
    zero = [f"n_{k}" for k in ("contracts", "ledger", *C.CHECKS)]
    wide = wide.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("bigint") if c in wide.columns else F.lit(0).cast("bigint") for c in zero})
    wide = cut(wide.withColumn("n_BANK-01", F.when(F.col("n_ledger") > 0, F.col("n_BANK-01")).otherwise(F.lit(0))))
    counted = [k for k in checks if k not in C.RATIOS]
    rows = []
    for k, (severity, present) in C.case_severity(counted).items():
        n = F.when(F.col("tenant_id").isNotNull(), F.col(f"`n_{k}`")).otherwise(F.lit(0)).cast("bigint")
        rows.append(F.when(present, F.struct(F.lit(k).alias("check_id"), severity.alias("severity"), (n == 0).alias("passed"), (F.lit(0).cast("bigint") if k == "RISK-01" else n).alias("n_flagged"))))
    out = [wide.select("tenant_id", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("tenant_id", "f.*")] if rows else []
    if want & C.RATIOS:
        out.append(C._ratio_findings(wide).where(F.col("check_id").isin(list(want & C.RATIOS))).drop("measure"))
    return reduce(DataFrame.unionByName, out)
