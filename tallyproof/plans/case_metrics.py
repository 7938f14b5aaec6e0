"""Registered queries for metrics, cash flow, filters, alerts (M, F, W)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import alerts as A, metrics as M
from ..sources import driver_tables as D
from .adapters_sql import with_tables
from .registry import query

TODAY = "date '1998-06-01'"
CLOSED = "('PAID','WRITTEN_OFF','CANCELLED','VOID')"

query("M1_concentration", with_tables("inv", extra="b as (select tenant_id, buyer_name as buyer, sum(total_amount) as amount, count(*) as n, min(seq) as s from inv group by 1,2)") + """
select tenant_id, place, buyer, cast(amount as double) as amount, round(cast(amount as double)/cast(total_billed as double),4) as share, cast(total_billed as double) as total_billed, buyer_count, invoice_count
from (select *, row_number() over (partition by tenant_id order by amount desc, s) as place, sum(amount) over (partition by tenant_id) as total_billed,
  count(*) over (partition by tenant_id) as buyer_count, cast(sum(n) over (partition by tenant_id) as bigint) as invoice_count from b) z where place<=5""")(
    lambda spark, sf: M.concentration(D.invoices(spark, sf)))

_AGE = f"""o as (select tenant_id, total_amount, case when {TODAY}-due_date<=0 then 'current' when {TODAY}-due_date<=30 then '1-30' when {TODAY}-due_date<=60 then '31-60'
  when {TODAY}-due_date<=90 then '61-90' else 'over 90' end as bucket from inv where status not in {CLOSED}),
t as (select i.tenant_id, coalesce(max(x.s),0) as open_total, coalesce(max(x.c),0) as cur, sum(case when status='WRITTEN_OFF' then total_amount else 0 end) as wo, sum(total_amount) as billed
  from inv i left join (select tenant_id, sum(total_amount) as s, sum(case when bucket='current' then total_amount else 0 end) as c from o group by 1) x on x.tenant_id=i.tenant_id group by 1)"""
query("M2_ageing", with_tables("inv", extra=_AGE) + """
select t.tenant_id, b.bucket, cast(coalesce(x.a,0) as double) as amount, coalesce(x.n,0) as n,
  round(cast(coalesce(x.a,0) as double)/coalesce(nullif(cast(open_total as double),0),1),4) as share, cast(open_total as double) as open_total,
  round(cast(open_total-cur as double)/coalesce(nullif(cast(open_total as double),0),1),4) as overdue_ratio, round(cast(wo as double)/cast(billed as double),4) as written_off_ratio
from t cross join (select unnest(['current','1-30','31-60','61-90','over 90']) as bucket) b
left join (select tenant_id, bucket, sum(total_amount) as a, count(*) as n from o group by 1,2) x on x.tenant_id=t.tenant_id and x.bucket=b.bucket""")(
    lambda spark, sf: M.ageing(D.invoices(spark, sf), D.AS_OF))

query("M3_summary", with_tables("inv") + f"""
select tenant_id, cast(sum(total_amount) as double) as billed_total, cast(sum(case when status not in {CLOSED} then total_amount else 0 end) as double) as open_total,
  count(*) as invoice_count, count(*) filter (where status not in {CLOSED}) as open_count, round(avg(payment_terms_days),1) as avg_terms_days,
  cast(min(invoice_date) as varchar) as first_date, cast(max(invoice_date) as varchar) as last_date from inv group by 1""")(
    lambda spark, sf: M.summary(D.invoices(spark, sf)))

_EVENTS = f"""opening as (select tenant_id, max_by(balance, seq) as opening from led group by 1),
opex as (select tenant_id, 20000 as monthly_opex from (select distinct tenant_id from inv) z),
ev as (select tenant_id, due_date as d, 1 as kind, seq, total_amount as amount, invoice_number as reference from inv where status='PENDING' and due_date between {TODAY} and {TODAY}+90
 union all select tenant_id, due_date, 2, seq, -amount, bill_number from bil where status='PENDING' and due_date between {TODAY} and {TODAY}+90
 union all select tenant_id, d, 0, 0, -monthly_opex, '' from opex cross join (select unnest([date '1998-06-05', date '1998-07-05', date '1998-08-05']) as d) m),
tl as (select ev.*, coalesce(opening,0) + sum(amount) over (partition by ev.tenant_id order by d, kind, seq, reference rows unbounded preceding) as balance
 from ev left join opening on opening.tenant_id=ev.tenant_id)"""


def _events(spark, sf):
    inv, led, bil = D.invoices(spark, sf), D.ledger(spark, sf), D.bills(spark, sf)
    opex = inv.select("tenant_id").distinct().withColumn("monthly_opex", F.lit(20000))
    return inv, M.cash_events(inv, bil, D.AS_OF, 90, opex), M.opening_balance(led)


@query("M4_cash_timeline", with_tables("inv", "led", "bil", extra=_EVENTS) + """
select tenant_id, cast(d as varchar) as d, kind, reference, cast(amount as double) as amount, cast(balance as double) as balance from tl""")
def _timeline(spark, sf):
    _, e, o = _events(spark, sf)
    return M.cash_timeline(e, o).select("tenant_id", "d", "kind", "reference", "amount", "balance")


@query("M4_cash_gap", with_tables("inv", "led", "bil", extra=_EVENTS) + """
select g.tenant_id, cast(coalesce(opening,0) as double) as opening, n_events, gap_date is not null as gap_detected, cast(gap_date as varchar) as gap_date, cast(gap_amount as double) as gap_amount,
  cast(trough as double) as trough, cast(trough_date as varchar) as trough_date, cast(0 as double) as overdue_total
from (select tenant_id, count(*) as n_events, min(d) filter (where balance<0) as gap_date,
   min_by(balance, (d,kind,seq,reference)) filter (where balance<0) as gap_amount, min(balance) as trough, min_by(d, (balance,d,kind,seq,reference)) as trough_date from tl group by 1) g
left join opening on opening.tenant_id=g.tenant_id""")
def _gap(spark, sf):
    inv, e, o = _events(spark, sf)
    return M.cash_gap(M.cash_timeline(e, o), o, M.overdue_total(inv))


SCENARIOS = [(500_000.0, 30), (5_000_000.0, 60), (1.0, 10)]


@query("M5_what_if", with_tables("inv", "led", "bil", extra=_EVENTS + """,
sc as (select * from (values (0, 0, null), (1, 500000, date '1998-07-01'), (2, 5000000, date '1998-07-31'), (3, 1, date '1998-06-11')) v(scenario, amount, d)),
ev2 as (select scenario, ev.tenant_id, ev.d, kind, seq, ev.amount, reference from ev cross join sc
  union all select scenario, tenant_id, d, 3, 0, -amount, 'SIM-WHATIF' from sc cross join (select distinct tenant_id from inv) z where scenario>0),
tl2 as (select ev2.*, coalesce(opening,0) + sum(amount) over (partition by scenario, ev2.tenant_id order by d, kind, seq, reference rows unbounded preceding) as balance
  from ev2 left join opening on opening.tenant_id=ev2.tenant_id),
g as (select tenant_id, scenario, min(balance) as trough, min_by(d, (balance,d,kind,seq,reference)) as trough_date from tl2 group by 1,2)""") + """
select a.tenant_id, a.scenario, cast(b.trough as double) as base_trough, cast(a.trough as double) as trough, cast(a.trough_date as varchar) as trough_date,
  cast(b.trough-a.trough as double) as trough_drop, b.trough>=0 and a.trough<0 as turns_negative,
  case when b.trough>=0 and a.trough<0 then 'turns negative' when b.trough<>a.trough then 'lower trough' else 'no effect' end as verdict
from g a join g b on a.tenant_id=b.tenant_id and b.scenario=0 where a.scenario>0""")
def _whatif(spark, sf):
    inv, e, o = _events(spark, sf)
    return M.what_if(e, o, inv.select("tenant_id").distinct(), D.AS_OF, SCENARIOS)


query("M6_inflow_timeline", with_tables("inv", "led", extra=f"""g as (select tenant_id, due_date as d, sum(total_amount) as inflow, count(*) as n from inv where status not in {CLOSED} group by 1,2),
o as (select tenant_id, max_by(balance, (txn_date, seq)) as opening from led group by 1)""") + """
select g.tenant_id, cast(d as varchar) as d, cast(inflow as double) as inflow, n,
  round(cast(coalesce(opening,0) + sum(inflow) over (partition by g.tenant_id order by d rows unbounded preceding) as double), 0) as balance
from g left join o on o.tenant_id=g.tenant_id""")(lambda spark, sf: M.inflow_timeline(D.invoices(spark, sf), D.ledger(spark, sf)))


def cases(spark, sf):
    s = D.table(spark, sf, "supplier")
    return s.select(F.format_string("CASE-%04d", F.col("s_suppkey").cast("bigint")).alias("tenant_id"), F.col("s_name").alias("client_name"),
                    F.date_add(F.lit("1993-01-01").cast("date"), F.col("s_nationkey") * 30).alias("created_on"))


CASES_SQL = "cases as (select printf('CASE-%04d', s_suppkey) as tenant_id, s_name as client_name, date '1993-01-01' + cast(s_nationkey*30 as int) as created_on from supplier)"

# ---- monitoring rules --------------------------------------------------------------------------------------------
W_SQL = {
    "W1": f"select tenant_id, seq, invoice_number, buyer_name, buyer_ban, cast(due_date as varchar) as due_date, cast(total_amount as double) as total_amount from inv where status not in {CLOSED} and due_date between {TODAY} and {TODAY}+7",
    "W2": f"select tenant_id, seq, invoice_number, buyer_name, buyer_ban, cast(due_date as varchar) as due_date, cast(total_amount as double) as total_amount, {TODAY}-due_date as days_overdue from inv where status not in {CLOSED} and due_date < {TODAY}",
    "W3": f"select tenant_id, buyer_name, buyer_ban, cast(amt as double) as amt, pct from (select *, round(100*cast(amt as double)/cast(sum(amt) over (partition by tenant_id) as double),2) as pct from (select tenant_id, buyer_name, buyer_ban, sum(total_amount) as amt from inv where status not in {CLOSED} group by 1,2,3) a) b where pct>=40",
    "W4": """select i.tenant_id, i.seq, invoice_number, i.buyer_name, i.buyer_ban, contract_number, i.payment_terms_days as invoice_terms, c.payment_terms_days as contract_terms, i.payment_terms_days-c.payment_terms_days as diff_days,
      cast(invoice_date as varchar) as invoice_date, cast(total_amount as double) as total_amount from inv i join con c on c.tenant_id=i.tenant_id and c.buyer_ban=i.buyer_ban and invoice_date>=effective_date and invoice_date<=expiry_date
      where abs(i.payment_terms_days-c.payment_terms_days)>3""",
    "W5": "select tenant_id, buyer_name, buyer_ban, count(*) filter (where paid_date>due_date) as late_cnt, count(*) as paid_cnt, max(paid_date-due_date) as worst_delay from inv where status='PAID' group by 1,2,3 having count(*) filter (where paid_date>due_date)>=2",
    "W6": f"""select tenant_id, round(r,1) as recent_dso, round(p,1) as prior_dso, round(100*(r-p)/p,1) as change_pct, n_recent from (select tenant_id, avg(paid_date-invoice_date) filter (where paid_date>={TODAY}-90) as r,
      avg(paid_date-invoice_date) filter (where paid_date>={TODAY}-180 and paid_date<{TODAY}-90) as p, count(*) filter (where paid_date>={TODAY}-90) as n_recent from inv where status='PAID' group by 1) z where n_recent>=10 and p>0 and 100*(r-p)/p>=15""",
    "W7": """select i.tenant_id, i.buyer_ban, i.buyer_name, cast(i.total_amount as double) as total_amount, n, spread, invoice_number, cast(invoice_date as varchar) as invoice_date, seq from inv i join
      (select tenant_id, buyer_ban, buyer_name, total_amount, count(*) as n, max(invoice_date)-min(invoice_date) as spread from inv group by 1,2,3,4 having count(*)>1 and max(invoice_date)-min(invoice_date)<=7) g
      on g.tenant_id=i.tenant_id and g.buyer_ban=i.buyer_ban and g.buyer_name=i.buyer_name and g.total_amount=i.total_amount""",
}
W_FN = {
    "W1": lambda i, c: A.due_soon(i, D.AS_OF), "W2": lambda i, c: A.overdue(i, D.AS_OF), "W3": lambda i, c: A.open_share(i),
    "W4": A.terms_mismatch, "W5": lambda i, c: A.late_payers(i), "W6": lambda i, c: A.collection_slowdown(i, D.AS_OF), "W7": lambda i, c: A.repeated_billing(i),
}
W_NAME = {"W1": "due_soon", "W2": "overdue", "W3": "open_share", "W4": "terms_mismatch", "W5": "late_payers", "W6": "collection_slowdown", "W7": "repeated_billing"}
for _k in W_SQL:
    query(f"{_k}_{W_NAME[_k]}", with_tables("inv", "con") + W_SQL[_k])(lambda spark, sf, k=_k: W_FN[k](D.invoices(spark, sf), D.contracts(spark, sf)))

_KEYS = {
    "W1": "concat_ws('|', invoice_number, buyer_ban, due_date, cast(cast(total_amount as decimal(18,2)) as varchar)) as key, total_amount as amount, 0 as days, 'info' as severity",
    "W2": "concat_ws('|', invoice_number, buyer_ban, due_date, cast(cast(total_amount as decimal(18,2)) as varchar)) as key, total_amount as amount, days_overdue as days, 'warning' as severity",
    "W3": "concat_ws('|', buyer_ban, cast(cast(amt as decimal(18,2)) as varchar)) as key, amt as amount, 0 as days, 'warning' as severity",
    "W4": "concat_ws('|', invoice_number, buyer_ban, contract_number, cast(invoice_terms as varchar), cast(contract_terms as varchar)) as key, total_amount as amount, diff_days as days, 'warning' as severity",
    "W5": "concat_ws('|', buyer_ban, buyer_name, cast(late_cnt as varchar), cast(paid_cnt as varchar), cast(worst_delay as varchar)) as key, 0 as amount, worst_delay as days, 'warning' as severity",
    "W6": "concat_ws('|', cast(n_recent as varchar), printf('%.1f', recent_dso)) as key, 0 as amount, 0 as days, 'warning' as severity",
    "W7": "concat_ws('|', buyer_ban, cast(cast(total_amount as decimal(18,2)) as varchar), invoice_number, invoice_date) as key, total_amount as amount, 0 as days, 'warning' as severity",
}
_EVID = " union all ".join(f"select tenant_id, 'WATCH-0{k[1]}' as rule_id, key, cast(amount as decimal(38,2)) as amount, days, severity from (select *, {_KEYS[k]} from ({W_SQL[k]}) s{k}) t{k}" for k in W_SQL)
HEAD_SQL = f"""evid as ({_EVID}),
heads as (select tenant_id, rule_id, case when rule_id='WATCH-02' and max(days)>=90 then 'critical' else max(severity) end as severity, count(*) as n_evidence, sum(amount) as amount, max(days) as worst_days, min(key) as first_key,
  substr(sha256(concat_ws('|', rule_id, cast(count(*) as varchar), cast(sum(h) as varchar), cast(bit_xor(h) as varchar))),1,32) as fingerprint
  from (select *, cast(('0x' || substr(md5(concat_ws('#', rule_id, key)),1,15)) as bigint) as h from evid) e group by 1,2)"""


@query("W8_scan", with_tables("inv", "con", extra=HEAD_SQL) + "select tenant_id, rule_id, severity, n_evidence, cast(amount as double) as amount, worst_days, first_key from heads")
def _scan(spark, sf):
    return A.scan(D.invoices(spark, sf), D.contracts(spark, sf), D.AS_OF).drop("fingerprint")


@query("W9_fingerprint", with_tables("inv", "con", extra=HEAD_SQL) + "select tenant_id, rule_id, fingerprint from heads")
def _fingerprint(spark, sf):
    return A.scan(D.invoices(spark, sf), D.contracts(spark, sf), D.AS_OF).select("tenant_id", "rule_id", "fingerprint")


def _store(spark, sf):
    """An alert store as an earlier scan would have left it: every alert of the scan with at least five evidence rows,
    known since one of the two days before; info alerts are resolved."""
    h = A.scan(D.invoices(spark, sf), D.contracts(spark, sf), D.AS_OF)
    seen = F.when(F.col("n_evidence") >= 50, F.lit("1998-05-30")).otherwise(F.lit("1998-05-31"))
    s = h.where("n_evidence >= 5").select("tenant_id", "fingerprint", "rule_id", "severity", "n_evidence", seen.alias("first_seen_at"), seen.alias("last_seen_at"),
                                          F.when(F.col("severity") == "info", F.lit("1998-05-31")).alias("resolved_at"))
    return s, h


_STORE_SQL = HEAD_SQL + """,
store as (select tenant_id, fingerprint, rule_id, severity, n_evidence, case when n_evidence>=50 then '1998-05-30' else '1998-05-31' end as seen,
  case when severity='info' then '1998-05-31' end as resolved_at from heads where n_evidence>=5),
merged as (select h.tenant_id, h.fingerprint, h.rule_id, h.severity, h.n_evidence, coalesce(s.seen, '1998-06-01') as first_seen_at, '1998-06-01' as last_seen_at, s.resolved_at
  from heads h left join store s on s.tenant_id=h.tenant_id and s.fingerprint=h.fingerprint)"""


@query("W10_alert_upsert", with_tables("inv", "con", extra=_STORE_SQL) + "select tenant_id, fingerprint, rule_id, severity, n_evidence, first_seen_at, last_seen_at, coalesce(resolved_at,'') as resolved_at from merged")
def _upsert(spark, sf):
    s, h = _store(spark, sf)
    return A.upsert(s, h, F.lit("1998-06-01")).withColumn("resolved_at", F.coalesce("resolved_at", F.lit("")))


@query("W11_open_alerts", with_tables("inv", "con", extra=_STORE_SQL) + "select tenant_id, fingerprint, rule_id, severity, first_seen_at from merged where resolved_at is null")
def _open(spark, sf):
    s, h = _store(spark, sf)
    return A.open_alerts(A.upsert(s, h, F.lit("1998-06-01"))).select("tenant_id", "fingerprint", "rule_id", "severity", "first_seen_at")


@query("M7_case_queue", with_tables("inv", "con", extra=CASES_SQL + "," + HEAD_SQL) + f"""
select c.tenant_id, client_name, cast(created_on as varchar) as created_on, {TODAY}-created_on as ageing_days,
  case when nc>0 then 'critical' when nw>0 then 'warning' else 'good' end as light, case when nc>0 then 0 when nw>0 then 1 else 2 end as light_rank, coalesce(nc,0) as n_critical, coalesce(nw,0) as n_warning, coalesce(ni,0) as n_info
from cases c left join (select tenant_id, count(*) filter (where severity='critical') as nc, count(*) filter (where severity='warning') as nw, count(*) filter (where severity='info') as ni from heads group by 1) a on a.tenant_id=c.tenant_id""")
def _queue(spark, sf):
    h = A.scan(D.invoices(spark, sf), D.contracts(spark, sf), D.AS_OF).withColumn("resolved_at", F.lit(None).cast("date"))
    return M.case_queue(cases(spark, sf), h, D.AS_OF).orderBy("light_rank", F.desc("ageing_days"), "tenant_id")


# ---- filters -----------------------------------------------------------------------------------------------------
@query("F1_open_filter", with_tables("inv") + f"select tenant_id, count(*) filter (where upper(coalesce(s,'')) not in {CLOSED}) as n_open, count(*) filter (where s not in {CLOSED}) as n_open_strict from (select tenant_id, case when payment_terms_days=45 then null when payment_terms_days=90 then lower(status) else status end as s from inv) z group by 1")
def _open_filter(spark, sf):
    """Both flavours on statuses of which some are missing or in lower case."""
    s = F.when(F.col("payment_terms_days") == 45, F.lit(None)).when(F.col("payment_terms_days") == 90, F.lower("status")).otherwise(F.col("status"))
    return D.invoices(spark, sf).groupBy("tenant_id").agg(F.count_if(ids.is_open(s)).alias("n_open"), F.count_if(ids.is_open_strict(s)).alias("n_open_strict"))


@query("F5_positive_guard", "select c_mktsegment, count(*) filter (where v is not null and not isnan(v) and v>0) as n_valid, count(*) as n from (select c_mktsegment, case when c_nationkey=1 then cast('nan' as double) when c_nationkey=2 then null else c_acctbal end as v from customer) z group by 1")
def _positive(spark, sf):
    v = F.when(F.col("c_nationkey") == 1, F.lit(float("nan"))).when(F.col("c_nationkey") == 2, F.lit(None)).otherwise(F.col("c_acctbal"))
    return D.table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count_if(M.positive_number(v)).alias("n_valid"), F.count("*").alias("n"))


_REFS = """refs as (select distinct tenant_id, ref from (select tenant_id, reference as ref from led union all select tenant_id, contract_number from con union all select tenant_id, buyer_ban from con) z where ref<>''),
hits as (select tenant_id, invoice_number as ref, 'invoice' as kind, seq, total_amount as amount from inv union all select tenant_id, contract_number, 'contract', seq, annual_commitment_amount from con
  union all select tenant_id, reference, 'ledger', seq, amount from led),
found as (select r.tenant_id, r.ref, kind, seq, amount from refs r join hits h on h.tenant_id=r.tenant_id and h.ref=r.ref),
party as (select tenant_id, seq, total_amount as amount, buyer_ban as ref from inv union select tenant_id, seq, total_amount, seller_ban from inv)"""


@query("F6_evidence_lookup", with_tables("inv", "con", "led", extra=_REFS) + """
select tenant_id, ref, kind, seq, cast(amount as double) as amount from found union all
select tenant_id, ref, 'invoice by party', seq, cast(amount as double) from (select p.*, row_number() over (partition by p.tenant_id, p.ref order by p.seq) as rn from party p
  join refs r on r.tenant_id=p.tenant_id and r.ref=p.ref where not exists (select 1 from found f where f.tenant_id=p.tenant_id and f.ref=p.ref)) z where rn<=5""")
def _lookup(spark, sf):
    inv, con, led = D.invoices(spark, sf), D.contracts(spark, sf), D.ledger(spark, sf)
    refs = led.select("tenant_id", F.col("reference").alias("ref")).union(con.select("tenant_id", "contract_number")).union(con.select("tenant_id", "buyer_ban"))
    return M.lookup_evidence(refs, inv, con, led)


@query("F7_retention", "with " + CASES_SQL + f" select tenant_id, cast(created_on as varchar) as created_on, cast(cast(created_on + interval 5 year as date) as varchar) as keep_until, cast(created_on + interval 5 year as date) < {TODAY} as expired from cases")
def _retention(spark, sf):
    return M.retention(cases(spark, sf), 5, D.AS_OF).select("tenant_id", "created_on", "keep_until", "expired")


@query("F8_staleness", f"select o_orderpriority, count(*) filter (where {TODAY} - cast(o_orderdate as date) > 90) as n_stale, count(*) as n from orders group by 1")
def _stale(spark, sf):
    return D.table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count_if(M.stale(F.to_date("o_orderdate"), dt.date(1998, 6, 1))).alias("n_stale"), F.count("*").alias("n"))
