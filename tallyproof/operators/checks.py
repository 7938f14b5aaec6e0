"""Deterministic document checks over the invoices, contracts and ledger of many cases.

Checks that judge one row (alone, or next to its contract) share one pass: each row yields the array of checks it
breaks, and the exploded rows are counted per (case, check). Counting is a partial aggregate and the kept references
are a top-20 with a group limit, so a case holding a third of all invoices does not gather in one task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids
from ..functions.ordered import chain, first_per_key, number_runs, same, seq_block
from ..session import cut
from .reconcile import reconcile

REF_LIMIT = 20

# Check id -> (severity, title).
CHECKS = {
    "TAXID-01": ("critical", "business number checksum"),
    "ARITH-01": ("critical", "sales plus tax equals total"),
    "ARITH-02": ("warning", "tax is five percent of sales"),
    "DATE-01": ("critical", "invoice date not in the future"),
    "DATE-02": ("critical", "due date not before invoice date"),
    "DATE-03": ("warning", "terms within 365 days"),
    "AMT-01": ("critical", "total is positive"),
    "AMT-02": ("critical", "tax is not negative"),
    "AMT-03": ("warning", "single amount within usual size"),
    "FRAUD-01": ("critical", "seller differs from buyer"),
    "DUP-01": ("critical", "invoice numbers are unique"),
    "DUP-02": ("warning", "no repeated buyer, amount and date"),
    "SEQ-01": ("warning", "no consecutive numbers for one buyer"),
    "RELATED-01": ("info", "id prefixes differ between the parties"),
    "TERM-01": ("warning", "due date equals invoice date plus terms"),
    "TERM-02": ("warning", "terms match the contract"),
    "TERM-03": ("warning", "invoice not before the contract takes effect"),
    "CONTRACT-01": ("warning", "large invoices are backed by a contract"),
    "CONTRACT-02": ("warning", "billing within the yearly commitment"),
    "BANK-01": ("critical", "paid invoices appear in the bank ledger"),
    "LEDGER-01": ("critical", "ledger balances are continuous"),
    "FORENSIC-01": ("warning", "share of round amounts"),
    "FORENSIC-02": ("warning", "first digits follow Benford"),
    "FORENSIC-03": ("warning", "share of weekend invoices"),
    "RISK-01": ("warning", "largest buyer share"),
    "RISK-02": ("warning", "overdue share of open amount"),
    "RISK-03": ("warning", "write-off share of billing"),
}
ROW_CHECKS = ["TAXID-01", "ARITH-01", "ARITH-02", "DATE-01", "DATE-02", "DATE-03", "AMT-01", "AMT-02", "AMT-03",
              "FRAUD-01", "RELATED-01", "TERM-01", "TERM-02", "TERM-03", "CONTRACT-01"]
LISTED = ["FORENSIC-03", "RISK-02", "RISK-03"]  # judged by a ratio; their rows are listed
WEIGHTS = {"critical": 3, "warning": 1, "info": 0}
FINDING = ["tenant_id", "check_id", "severity", "passed", "n_flagged", "measure", "refs"]

TAX_RATE = "0.05"
SUM_TOLERANCE, TAX_TOLERANCE = 1.0, 1.5
HUGE_AMOUNT = 50_000_000
BENFORD_CRITICAL, BENFORD_MIN_N, BENFORD_MIN_DECADES = 15.507, 50, 1.5


def _number(c: str = "invoice_number") -> Column:
    return F.coalesce(F.col(c), F.lit("None"))


def last_contract(con: DataFrame) -> DataFrame:
    """One contract per (case, cleaned buyer id): the last in input order. Ids that clean to NULL share one entry."""
    c = con.where(F.coalesce(F.col("buyer_ban"), F.lit("")) != "").withColumn("_buyer", ids.clean_ban(F.col("buyer_ban")))
    last = c.groupBy("tenant_id", "_buyer").agg(F.max_by(
        F.struct(F.col("payment_terms_days").alias("c_terms"),
                 F.coalesce("effective_date", *(["start_date"] if "start_date" in con.columns else [])).alias("c_start"),
                 F.coalesce("annual_commitment_amount", F.lit(0)).alias("c_commit")),
        F.struct("seq", "contract_number")).alias("c"))
    return last.select("tenant_id", "_buyer", "c.*", F.lit(True).alias("c_found"))


def with_contract(inv: DataFrame, con: DataFrame) -> DataFrame:
    c = last_contract(con).withColumnRenamed("tenant_id", "_ct").withColumnRenamed("_buyer", "_cb")
    i = inv.withColumn("_buyer", ids.clean_ban(F.col("buyer_ban")))
    return i.join(c, same(i, c, [("tenant_id", "_ct"), ("_buyer", "_cb")]), "left").drop("_ct", "_cb")


def row_rules(as_of: dt.date) -> dict[str, list[Column]]:
    """Conditions under which an invoice breaks a rule or is listed, for checks that look at the row alone. ``_seller`` and ``_clean`` are its cleaned ids."""
    c = F.col
    idate, due = c("invoice_date"), c("due_date")
    sales, tax, total = c("sales_amount"), c("tax_amount"), c("total_amount")
    seller, buyer = c("_seller"), c("_clean")
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    whole = sales.isNotNull() & tax.isNotNull() & total.isNotNull()
    return {
        "TAXID-01": [given(c(r)) & ~ids.ban_valid(k, cleaned=True) for r, k in (("seller_ban", seller), ("buyer_ban", buyer))],
        "ARITH-01": [whole & (F.abs(sales + tax - total) > SUM_TOLERANCE)],
        "ARITH-02": [whole & (F.abs(tax - F.bround(sales * F.lit(TAX_RATE).cast("decimal(4,2)"), 0)) > TAX_TOLERANCE)],
        "DATE-01": [idate > F.lit(as_of)],
        "DATE-02": [due < idate],
        "DATE-03": [F.datediff(due, idate) > 365],
        "AMT-01": [total.isNull() | (total <= 0)],
        "AMT-02": [tax < 0],
        "AMT-03": [total > HUGE_AMOUNT],
        "FRAUD-01": [given(c("seller_ban")) & seller.eqNullSafe(buyer)],
        "RELATED-01": [(seller != buyer) & (F.substring(seller, 1, 4) == F.substring(buyer, 1, 4))],
        "TERM-01": [F.abs(F.datediff(due, idate) - c("payment_terms_days")) > 1],
        "FORENSIC-03": [F.weekday("invoice_date") >= 5],
        "RISK-02": [ids.is_open(c("status")) & (due < F.lit(as_of))],
        "RISK-03": [F.upper(c("status")) == "WRITTEN_OFF"],
    }


def row_violations(inv: DataFrame, con: DataFrame | None, as_of: dt.date, only: Iterable[str] = ROW_CHECKS) -> DataFrame:
    """(tenant_id, check_id, seq, part, ref): one row per broken row-level rule, and the rows that ratio checks list."""
    only = list(only)
    by_contract = {"TERM-02", "TERM-03", "CONTRACT-01"} & set(only)
    need_contract = bool(by_contract) and con is not None
    if need_contract and set(only) - by_contract:  # only the columns of the contract rules are shuffled to the contracts
        return row_violations(inv, None, as_of, [k for k in only if k not in by_contract]).unionByName(
            row_violations(inv, con, as_of, [k for k in only if k in by_contract]))
    d = with_contract(inv.select("tenant_id", "seq", "invoice_number", "buyer_ban", "payment_terms_days", "invoice_date", "total_amount"), con) if need_contract else inv
    if need_contract and "CONTRACT-01" in only:
        # one row per case that has contracts; other cases get no threshold and so no violation
        t = large_threshold(inv).join(con.select("tenant_id").distinct(), "tenant_id", "left_semi")
        d = d.join(t, "tenant_id", "left")
    c = F.col
    idate, total = c("invoice_date"), c("total_amount")
    if not need_contract and {"TAXID-01", "FRAUD-01", "RELATED-01"} & set(only):  # cleaned once, used by several rules
        d = d.withColumns({"_seller": ids.clean_ban(c("seller_ban")), "_clean": ids.clean_ban(c("buyer_ban"))})
    rules = {} if need_contract else row_rules(as_of)
    if need_contract:
        rules["TERM-02"] = [c("c_found") & (c("payment_terms_days") != c("c_terms"))]
        rules["TERM-03"] = [c("c_found") & (idate < c("c_start"))]
        if "CONTRACT-01" in only:
            rules["CONTRACT-01"] = [c("c_found").isNull() & (F.coalesce(total, F.lit(0)) >= c("threshold"))]
    hits = [F.when(cond, F.struct(F.lit(k).alias("check_id"), F.lit(i).alias("part")))
            for k in only if k in rules for i, cond in enumerate(rules[k])]
    out = d.select("tenant_id", "seq", _number().alias("ref"), F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return out.select("tenant_id", "h.check_id", "seq", "h.part", "ref")


def tally(viol: DataFrame, limit: int = REF_LIMIT) -> DataFrame:
    """Count per (case, check) and the first ``limit`` references in input order."""
    keys = ["tenant_id", "check_id"]
    n = viol.groupBy(*keys).agg(F.count("*").alias("n_flagged"))
    top = first_per_key(viol, keys, ["seq", "part", "ref"], limit)
    refs = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part", "ref"))), lambda s: s["ref"]).alias("refs"))
    return n.join(refs, keys)


def profile(inv: DataFrame, as_of: dt.date, more: Iterable[Column] = ()) -> DataFrame:
    """Every per-case count and sum that the ratio checks need, and ``more`` of them, in one partial aggregate."""
    c = F.col
    whole = F.floor(F.coalesce(c("sales_amount"), F.lit(0))).cast("bigint").cast("string")
    inv = inv.withColumns({"_sales": F.coalesce(c("sales_amount"), F.lit(0)), "_digit": F.substring(whole, 1, 1)})
    sales, digit = c("_sales"), c("_digit")
    total = F.coalesce(c("total_amount"), F.lit(0))
    opened = ids.is_open(c("status"))
    written_off = F.upper(F.coalesce(c("status"), F.lit(""))) == "WRITTEN_OFF"
    overdue = opened & (c("due_date") < F.lit(as_of))
    add = lambda cond: F.sum(F.when(cond, total).otherwise(0))
    return inv.groupBy("tenant_id").agg(
        F.count("*").alias("n_inv"),
        F.count_if(sales > 0).alias("n_sales"),
        F.count_if((sales > 0) & (sales % 10000 == 0)).alias("n_round"),
        F.count_if(sales >= 10).alias("n_benford"),
        F.max(F.when(sales >= 10, sales)).alias("max_sales"), F.min(F.when(sales >= 10, sales)).alias("min_sales"),
        *[F.count_if((sales >= 10) & (digit == str(k))).alias(f"d{k}") for k in range(1, 10)],
        F.count("invoice_date").alias("n_dated"),
        F.count_if(F.weekday("invoice_date") >= 5).alias("n_weekend"),
        F.sum(total).alias("billed"), add(opened).alias("open_amt"),
        F.count_if(overdue).alias("n_overdue"), add(overdue).alias("overdue_amt"),
        F.count_if(written_off).alias("n_written_off"), add(written_off).alias("written_off_amt"),
        *more,
    )


def _ratio_findings(prof: DataFrame) -> DataFrame:
    """FORENSIC-01..03, RISK-02, RISK-03 from the profile (no references yet)."""
    c = F.col
    n = c("n_benford").cast("double")
    chi = reduce(lambda a, b: a + b, [
        F.pow(c(f"d{k}") - n * F.log10(F.lit(1 + 1 / k)), 2) / (n * F.log10(F.lit(1 + 1 / k))) for k in range(1, 10)])
    apt = (c("n_benford") >= BENFORD_MIN_N) & (F.log10(c("max_sales").cast("double") / c("min_sales").cast("double")) >= BENFORD_MIN_DECADES)
    benford = F.when(apt, chi)
    rows = []

    def row(check, measure, limit, flagged, present=F.lit(True), severity=None):
        rows.append(F.when(present, F.struct(
            F.lit(check).alias("check_id"), (severity if severity is not None else F.lit(CHECKS[check][0])).alias("severity"),
            F.coalesce(measure < limit, F.lit(True)).alias("passed"), flagged.cast("bigint").alias("n_flagged"),
            measure.cast("double").alias("measure"))))

    row("FORENSIC-01", ids.ratio(c("n_round"), c("n_sales")), 0.25, c("n_round"), c("n_sales") > 0)
    row("FORENSIC-02", benford, BENFORD_CRITICAL, F.lit(0), severity=F.when(apt, "warning").otherwise("info"))
    row("FORENSIC-03", ids.ratio(c("n_weekend"), c("n_dated")), 0.20, c("n_weekend"), c("n_dated") > 0)
    row("RISK-02", ids.ratio(c("overdue_amt"), c("open_amt")), 0.30, c("n_overdue"))
    row("RISK-03", ids.ratio(c("written_off_amt"), c("billed")), 0.03, c("n_written_off"))
    return prof.select("tenant_id", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("tenant_id", "f.*")


# ---- checks that compare rows with each other -------------------------------------------------------------------

def duplicate_numbers(inv: DataFrame) -> DataFrame:
    """DUP-01: an invoice number used more than once (a missing number counts as the text None)."""
    g = inv.groupBy("tenant_id", _number().alias("ref")).agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where("n > 1")
    return g.select("tenant_id", F.lit("DUP-01").alias("check_id"), "seq", F.lit(0).alias("part"), "ref")


def repeated_buyers(inv: DataFrame, least: int = 2) -> DataFrame:
    """Invoices of the (case, buyer) pairs that have at least ``least`` of them; a pair is counted on its key alone."""
    keys = ["tenant_id", "buyer_ban"]
    pairs = inv.where(F.col("buyer_ban").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*keys)
    return inv.select("tenant_id", "buyer_ban", "seq", "invoice_number", "total_amount", "invoice_date").join(pairs, keys, "left_semi")


def duplicate_claims(inv: DataFrame) -> DataFrame:
    """DUP-02: same buyer, total and date more than once."""
    keys = ["buyer_ban", "total_amount", "invoice_date"]
    g = inv.dropna(subset=keys).groupBy("tenant_id", *keys).agg(F.count("*").alias("n"), F.min("seq").alias("seq")).where("n > 1")
    return g.select("tenant_id", F.lit("DUP-02").alias("check_id"), "seq", F.lit(0).alias("part"), F.lit("").alias("ref"))


def consecutive_runs(inv: DataFrame, block: int = 1_000_000) -> DataFrame:
    """SEQ-01: per buyer the longest run of invoice numbers rising by one, where it reaches three.

    Values are made distinct first; a repeated value ends its run and starts the next, which two copies show.
    """
    digits = F.regexp_extract("invoice_number", r"([0-9]{6,})$", 1)
    d = inv.where(F.coalesce("buyer_ban", F.lit("")) != "").select("tenant_id", "buyer_ban", "seq", digits.alias("n")).where("n <> ''")
    # numbers of any length as two integers: the last 18 digits and what is before them
    d = d.select("tenant_id", "buyer_ban", "seq", F.substring("n", -18, 18).cast("bigint").alias("lo"),
                 F.when(F.length("n") > 18, F.expr("substring(n, 1, length(n) - 18)").try_cast("bigint")).otherwise(0).alias("hi"))
    keys = ["tenant_id", "buyer_ban"]
    v = d.groupBy(*keys, "hi", "lo").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    v = v.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(2)).cast("int")))).withColumn("v", F.struct("hi", "lo"))
    follows = lambda a, b: ((a["hi"] == b["hi"]) & (b["lo"] - a["lo"] == 1)) | ((b["hi"] - a["hi"] == 1) & (b["lo"] == 0) & (a["lo"] == 10 ** 18 - 1))
    v = number_runs(v, keys, {"high": F.col("hi"), "range": F.floor(F.col("lo") / block)}, ["hi", "lo", "copy"], "v", follows, "run")
    runs = v.groupBy(*keys, "run").agg(F.count("*").alias("len"), F.min("first_seq").alias("first_seq"))
    best = runs.groupBy(*keys).agg(F.max("len").alias("max_run"), F.min("first_seq").alias("seq")).where("max_run >= 3")
    return best.select("tenant_id", F.lit("SEQ-01").alias("check_id"), "seq", F.lit(0).alias("part"),
                       F.concat("buyer_ban", F.lit("(run "), F.col("max_run").cast("string"), F.lit(")")).alias("ref"))


def large_threshold(inv: DataFrame, block: int = 1000) -> DataFrame:
    """Amount at position max(1, n div 4) of the totals in descending order, per case.

    Exact selection over distinct amounts with their counts, chained over amount ranges.
    """
    a = inv.groupBy("tenant_id", F.coalesce("total_amount", F.lit(0)).alias("amt")).agg(F.count("*").alias("n"))
    a = cut(a.withColumn("neg", -F.col("amt")))
    a = chain(a, ["tenant_id"], {"range": F.floor(F.col("neg") / block)}, ["neg"], sums={"upto": F.col("n")})
    n = inv.groupBy("tenant_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 4)).alias("k"))
    return a.join(n, "tenant_id").where("upto >= k").groupBy("tenant_id").agg(F.max("amt").alias("threshold"))


def over_commitment(inv: DataFrame, con: DataFrame) -> DataFrame:
    """CONTRACT-02: per buyer the first row, in input order, where billing passes twice the yearly commitment.

    Billing can only pass it where the positive amounts of the pair do, so rows of other pairs are not put in order.
    """
    pair = ["tenant_id", "_buyer"]
    amt = F.coalesce("total_amount", F.lit(0))
    d = inv.select("tenant_id", ids.clean_ban(F.col("buyer_ban")).alias("_buyer"), "seq", amt.alias("amt"))
    c = last_contract(con).where("c_commit <> 0").select(F.col("tenant_id").alias("_ct"), F.col("_buyer").alias("_cb"), "c_commit")
    most = d.groupBy(*pair).agg(F.sum(F.greatest("amt", F.lit(0))).alias("most"))
    due = most.join(c, same(most, c, [("tenant_id", "_ct"), ("_buyer", "_cb")])).where((F.col("most") > 2 * F.col("c_commit")) | (F.col("c_commit") < 0))
    due = due.select("_ct", "_cb", "c_commit")
    d = d.join(due, same(d, due, [("tenant_id", "_ct"), ("_buyer", "_cb")])).drop("_ct", "_cb")
    d = cut(d)  # read by the windows and by the totals of their blocks
    d = chain(d, pair, {"range": seq_block()}, ["seq"], sums={"acc": F.col("amt")})
    first = d.where(F.col("acc") > 2 * F.col("c_commit")).groupBy("tenant_id", "_buyer").agg(
        F.min("seq").alias("seq"), F.min_by("acc", "seq").alias("acc"), F.min_by("c_commit", "seq").alias("commit"))
    ref = F.concat(F.coalesce("_buyer", F.lit("None")), F.lit("("), F.format_string("%d", F.bround("acc", 0).cast("bigint")),
                   F.lit("/"), F.format_string("%d", F.bround("commit", 0).cast("bigint")), F.lit("x2)"))
    return first.select("tenant_id", F.lit("CONTRACT-02").alias("check_id"), "seq", F.lit(0).alias("part"), ref.alias("ref"))


def broken_balances(led: DataFrame, block: int = 1 << 16) -> DataFrame:
    """LEDGER-01: previous balance plus amount differs from the balance. Rows without numbers are stepped over."""
    d = led.where("balance is not null and amount is not null")
    d = chain(d, ["tenant_id"], {"range": seq_block("seq", block)}, ["seq"], previous={"before": F.col("balance")})
    d = d.where(F.abs(F.col("before") + F.col("amount") - F.col("balance")) > SUM_TOLERANCE)
    ref = F.concat(F.lit("#"), F.col("seq").cast("string"), F.lit("("), F.coalesce(F.col("txn_date").cast("string"), F.lit("None")), F.lit(")"))
    return d.select("tenant_id", F.lit("LEDGER-01").alias("check_id"), "seq", F.lit(0).alias("part"), ref.alias("ref"))


def buyer_name(c_name: str = "buyer_name", c_ban: str = "buyer_ban") -> Column:
    full = lambda x: F.when(F.col(x) != "", F.col(x))
    return F.coalesce(full(c_name), full(c_ban), F.lit("unknown"))


def top_buyer(inv: DataFrame) -> DataFrame:
    """RISK-01 basis: largest buyer, its amount, the case total. Ties keep the buyer seen first."""
    b = inv.groupBy("tenant_id", buyer_name().alias("buyer")).agg(
        F.sum(F.coalesce("total_amount", F.lit(0))).alias("amt"), F.min("seq").alias("first_seq"))
    t = b.groupBy("tenant_id").agg(F.sum("amt").alias("total"),
                                   F.max_by(F.struct("buyer", "amt"), F.struct("amt", -F.col("first_seq"))).alias("t"))
    return t.select("tenant_id", F.col("t.buyer").alias("buyer"), F.col("t.amt").alias("amt"), "total",
                    ids.ratio(F.col("t.amt"), F.col("total")).alias("share"))


def paid_without_inflow(inv: DataFrame, led: DataFrame, **kw) -> DataFrame:
    """BANK-01 violations: paid invoices with no matching inflow (cases with a ledger only)."""
    m = reconcile(inv, led, **kw).where("how = 'none'")
    m = m.join(led.select("tenant_id").distinct(), "tenant_id", "left_semi")
    return m.select("tenant_id", F.lit("BANK-01").alias("check_id"), "seq", F.lit(0).alias("part"), F.col("invoice_number").alias("ref"))


# ---- the whole set ----------------------------------------------------------------------------------------------

def count_documents(inv: DataFrame, con: DataFrame | None, led: DataFrame | None) -> DataFrame:
    """Rows of each table per case with invoices; a table that no wanted check looks at may be left out and counts 0."""
    d = inv.groupBy("tenant_id").agg(F.count("*").alias("n_invoices"))
    for t, name in ((con, "n_contracts"), (led, "n_ledger")):
        if t is None:
            d = d.withColumn(name, F.lit(0).cast("bigint"))
        else:
            d = d.join(t.groupBy("tenant_id").agg(F.count("*").alias(name)), "tenant_id", "left").na.fill(0, [name])
    return d


NEED_CONTRACT = {"TERM-02": "info", "TERM-03": None, "CONTRACT-01": "info", "CONTRACT-02": None}


def case_severity(checks: Iterable[str]) -> dict[str, tuple[Column, Column]]:
    """Severity of each check and whether it is there, by the documents a case has (n_contracts, n_ledger)."""
    out = {}
    for k in checks:
        sev, present = F.lit(CHECKS[k][0]), F.lit(True)
        if k in NEED_CONTRACT:
            has = F.col("n_contracts") > 0
            if NEED_CONTRACT[k]:
                sev = F.when(has, sev).otherwise(NEED_CONTRACT[k])
            else:
                present = has
        elif k == "BANK-01":
            sev = F.when(F.col("n_ledger") > 0, sev).otherwise("info")
        elif k == "LEDGER-01":
            sev = F.when(F.col("n_ledger") >= 2, sev).otherwise("info")
        out[k] = sev, present
    return out


def settle(docs: DataFrame, viol: DataFrame, checks: Iterable[str], measures: DataFrame | None = None) -> DataFrame:
    """Turn violations into findings: a row for every case and check, passed where nothing was flagged.

    Without contracts TERM-02 and CONTRACT-01 pass as info and TERM-03, CONTRACT-02 are absent; the ledger checks
    pass as info without a ledger (LEDGER-01: under two rows).
    """
    rows = [F.when(present, F.struct(F.lit(k).alias("check_id"), sev.alias("severity"))) for k, (sev, present) in case_severity(checks).items()]
    base = docs.select("tenant_id", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("tenant_id", "f.*")
    keys = ["tenant_id", "check_id"]
    out = base.join(tally(viol), keys, "left")
    if measures is not None:
        out = out.join(measures, keys, "left")
    else:
        out = out.withColumn("measure", F.lit(None).cast("double"))
    return out.select(
        *keys, "severity", F.col("n_flagged").isNull().alias("passed"), F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"), "measure",
        F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))


def bank_measure(inv: DataFrame, led: DataFrame, viol: DataFrame) -> DataFrame:
    """Share of paid invoices found in the ledger."""
    paid = inv.where(F.upper("status") == "PAID").groupBy("tenant_id").agg(F.count("*").alias("n_paid"))
    miss = viol.where("check_id = 'BANK-01'").groupBy("tenant_id").agg(F.count("*").alias("n_miss"))
    return paid.join(led.select("tenant_id").distinct(), "tenant_id", "left_semi").join(miss, "tenant_id", "left").select(
        "tenant_id", F.lit("BANK-01").alias("check_id"),
        (1 - F.coalesce("n_miss", F.lit(0)) / F.greatest("n_paid", F.lit(1))).alias("measure"))


NEED_LEDGER = {"BANK-01", "LEDGER-01"}
RATIOS = {"FORENSIC-01", "FORENSIC-02", "FORENSIC-03", "RISK-02", "RISK-03"}


class Verdicts(tuple):
    """Checks of which only the verdict is asked for: whether they pass and how many they flag, without references and measures."""


VERDICTS = Verdicts(CHECKS)


def findings(inv: DataFrame, con: DataFrame | None, led: DataFrame | None, as_of: dt.date, checks: Iterable[str] = tuple(CHECKS)) -> DataFrame:
    """All requested findings, one row per (case, check). ``con`` or ``led`` may be None where no requested check looks at it.
    Of ``Verdicts`` the rows have no ``measure`` and no ``refs``."""
    bare, checks = isinstance(checks, Verdicts), list(checks)
    want = set(checks)
    if (con is None and want & set(NEED_CONTRACT)) or (led is None and want & NEED_LEDGER):
        raise ValueError("a requested check needs contracts or a ledger")
    if bare:
        from .verdicts import verdicts
        return verdicts(inv, con, led, as_of, checks)
    docs = count_documents(inv, con, led)
    if {"DUP-02", "SEQ-01"} <= want:  # a pair of case and buyer seen once breaks neither
        repeated = cut(repeated_buyers(inv))
    else:
        repeated = inv
    row_level = [k for k in ROW_CHECKS if k in want]
    listed = [k for k in LISTED if k in want]
    make = {
        "DUP-01": lambda: duplicate_numbers(inv), "DUP-02": lambda: duplicate_claims(repeated), "SEQ-01": lambda: consecutive_runs(repeated),
        "CONTRACT-02": lambda: over_commitment(inv, con), "BANK-01": lambda: paid_without_inflow(inv, led), "LEDGER-01": lambda: broken_balances(led),
    }
    parts = [row_violations(inv, con, as_of, row_level + listed)] if row_level or listed else []
    parts += [make[k]() for k in make if k in want]
    none = F.array().cast("array<string>")
    out = viol = None
    if parts:
        viol = reduce(DataFrame.unionByName, parts)
        if len(parts) > 2 or want & set(NEED_CONTRACT):  # counted and ranked below: worked out once, stored, read twice
            viol = cut(viol)
    counted = [k for k in checks if k in row_level or k in make]
    if counted:
        measure = bank_measure(inv, led, viol) if "BANK-01" in want else None
        out = settle(docs, viol.where(~F.col("check_id").isin(listed)) if listed else viol, counted, measure)
        out = out.withColumn("refs", F.when(F.col("check_id") == "DUP-02", none).otherwise(F.col("refs")))
    ratios = RATIOS & want
    if ratios:
        r = _ratio_findings(profile(inv, as_of)).where(F.col("check_id").isin(list(ratios)))
        if listed:
            r = r.join(tally(viol.where(F.col("check_id").isin(listed))).select("tenant_id", "check_id", "refs"), ["tenant_id", "check_id"], "left")
        else:
            r = r.withColumn("refs", none)
        r = r.withColumn("refs", F.coalesce("refs", none)).select(*FINDING)
        out = r if out is None else out.unionByName(r)
    if "RISK-01" in want:
        t = top_buyer(inv).select(
            "tenant_id", F.lit("RISK-01").alias("check_id"), F.lit("warning").alias("severity"), (F.col("share") < 0.5).alias("passed"),
            F.lit(0).cast("bigint").alias("n_flagged"), F.col("share").alias("measure"), F.array().cast("array<string>").alias("refs"))
        out = t if out is None else out.unionByName(t)
    return out.select(*FINDING)


def scorecard(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Weighted share of passed checks, critical failures and readiness per case."""
    w = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 1).otherwise(0)
    g = found.groupBy("tenant_id").agg(
        F.sum(F.when(F.col("passed"), w).otherwise(0)).alias("earned"), F.sum(w).alias("possible"),
        F.count("*").alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("critical_failures"))
    score = F.bround((F.col("earned") / F.greatest("possible", F.lit(1))).cast("decimal(20,10)"), 3)
    return docs.join(g, "tenant_id").select(
        "tenant_id", "n_invoices", "n_contracts", "n_ledger", "n_checks", "n_failed", score.alias("integrity_score"),
        "critical_failures", (F.col("critical_failures") == 0).alias("submission_ready"))


# Report groups by check prefix, and the words by which a question names a check.
CHECK_GROUPS = {
    "憑證真偽": ["TAXID", "FRAUD"], "金額算術": ["ARITH", "AMT"], "重複請款": ["DUP", "SEQ"],
    "跨文件勾稽": ["TERM", "CONTRACT", "BANK", "LEDGER", "RELATED"], "鑑識會計": ["FORENSIC", "DATE"], "授信風險": ["RISK"],
}
CHECK_ALIASES = {
    "TAXID": ["統編", "統一編號", "檢核碼", "憑證真偽"], "FRAUD": ["自我交易", "造假", "憑證真偽"],
    "ARITH": ["金額", "加總", "算術", "稅率", "稅額"], "AMT": ["金額", "算術"], "DUP": ["重複", "重複請款", "發票號碼"],
    "SEQ": ["連號", "重複請款"], "TERM": ["帳期", "到期日", "跨文件", "勾稽", "合約"], "CONTRACT": ["合約", "跨文件", "勾稽"],
    "BANK": ["銀行", "流水", "對帳", "勾稽", "跨文件"], "LEDGER": ["流水", "勾稽", "跨文件"], "RELATED": ["關係人", "跨文件"],
    "DATE": ["日期", "時序", "鑑識"], "FORENSIC": ["班佛", "鑑識", "整數", "假日"], "RISK": ["集中度", "逾期", "呆帳", "授信風險"],
}


def prefix_of(check_id: Column) -> Column:
    return F.substring_index(check_id, "-", 1)


def group_rollup(found: DataFrame) -> DataFrame:
    """Findings by report group: passed, total and the worst status of the failed ones."""
    pairs = [x for g, ps in CHECK_GROUPS.items() for p in ps for x in (F.lit(p), F.lit(g))]
    name = F.coalesce(F.try_element_at(F.create_map(*pairs), prefix_of(F.col("check_id"))), F.lit("other"))
    rank = F.when(F.col("passed"), 0).when(F.col("severity") == "critical", 2).otherwise(1)
    g = found.groupBy("tenant_id", name.alias("check_group")).agg(
        F.count_if("passed").alias("n_passed"), F.count("*").alias("n_total"), F.max(rank).alias("r"))
    status = F.when(F.col("check_group") == "other", "warning").when(F.col("r") == 2, "critical").when(F.col("r") == 1, "warning").otherwise("good")
    return g.select("tenant_id", "check_group", status.alias("status"), "n_passed", "n_total")


def asked_prefixes(question: Column) -> Column:
    """Check prefixes a question names, by id or by one of their everyday words."""
    q = F.regexp_replace(question, r"\s+", "")
    hit = lambda p, ws: reduce(lambda a, b: a | b, [F.contains(F.lower(q), F.lit(p.lower()))] + [F.contains(q, F.lit(w)) for w in ws])
    return F.array_compact(F.array(*[F.when(hit(p, ws), F.lit(p)) for p, ws in CHECK_ALIASES.items()]))


def focus_findings(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Per question (question_id, tenant_id, q): findings it asks about first, then the other failed ones."""
    q = questions.withColumn("asked", asked_prefixes(F.col("q"))).select("question_id", "tenant_id", "asked")
    d = q.join(found, "tenant_id")
    focused = F.array_contains("asked", prefix_of(F.col("check_id")))
    d = d.where(focused | ~F.col("passed"))
    return d.select("question_id", "tenant_id", "check_id", F.when(focused, 0).otherwise(1).alias("tier"), "severity", "passed", "n_flagged")
