"""Registered document-check queries (C1-C30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..sources import driver_tables as D
from .adapters_sql import with_tables
from .registry import query

AS_OF = "date '1998-06-01'"


def _load(spark, sf, checks=tuple(C.CHECKS)):
    """The case tables that these checks look at; the others are not built."""
    return (D.invoices(spark, sf), D.contracts(spark, sf) if set(checks) & set(C.NEED_CONTRACT) else None,
            D.ledger(spark, sf) if set(checks) & C.NEED_LEDGER else None)


def _finding_sql(check: str, viol: str, tables=("inv",), severity: str | None = None, present: str = "true",
                 extra_cte: str = "", refs: bool = True, more: str = "") -> str:
    """Findings of one check from SQL that yields its violations (tenant_id, seq, part, ref)."""
    sev = severity or f"'{C.CHECKS[check][0]}'"
    ctes = (extra_cte + ",\n" if extra_cte else "") + f"viol as ({viol}),\n" + """
cnt as (select tenant_id, count(*) as n from viol group by tenant_id),
top as (select tenant_id, string_agg(ref, ',' order by seq, part, ref) as refs
        from (select *, row_number() over (partition by tenant_id order by seq, part, ref) as rn from viol) z where rn <= 20 group by tenant_id),
base as (select i.tenant_id, i.n_inv, coalesce(c.n,0) as n_con, coalesce(l.n,0) as n_led
         from (select tenant_id, count(*) as n_inv from inv group by 1) i
         left join (select tenant_id, count(*) as n from con group by 1) c on c.tenant_id=i.tenant_id
         left join (select tenant_id, count(*) as n from led group by 1) l on l.tenant_id=i.tenant_id)"""
    return with_tables("inv", "con", "led", extra=ctes) + f"""
select b.tenant_id, '{check}' as check_id, {sev} as severity, cnt.n is null as passed,
       coalesce(cnt.n, 0) as n_flagged, {"coalesce(top.refs, '')" if refs else "''"} as refs{more}
from base b left join cnt on cnt.tenant_id=b.tenant_id left join top on top.tenant_id=b.tenant_id where {present}"""


def _row_sql(check: str, cond: str, **kw) -> str:
    return _finding_sql(check, f"select tenant_id, seq, 0 as part, coalesce(invoice_number,'None') as ref from inv where {cond}", **kw)


def ban_ok_sql(col: str) -> str:
    total = "+".join(
        f"((cast(substr({col},{i + 1},1) as int)*{w})//10 + (cast(substr({col},{i + 1},1) as int)*{w})%10)"
        for i, w in enumerate(C.ids.BAN_WEIGHTS))
    return f"(length({col})=8 and (({total})%5=0 or (substr({col},7,1)='7' and (({total})+1)%5=0)))"


LASTCON = """lastcon as (select tenant_id, buyer_ban, max_by(payment_terms_days, contract_number) as c_terms,
  max_by(effective_date, contract_number) as c_start, max_by(annual_commitment_amount, contract_number) as c_commit from con group by 1,2)"""

_C1 = " union all ".join(
    f"select tenant_id, seq, {i} as part, invoice_number as ref from inv where not {ban_ok_sql(c)}"
    for i, c in enumerate(["seller_ban", "buyer_ban"]))

_SEQ = """
select tenant_id, min(first_seq) as seq, 0 as part, concat(buyer_ban, '(run ', cast(max(len) as varchar), ')') as ref from (
  select tenant_id, buyer_ban, grp, count(*) as len, min(first_seq) as first_seq from (
    select *, sum(case when v - prev = 1 then 0 else 1 end) over (partition by tenant_id, buyer_ban order by v, seq rows unbounded preceding) as grp from (
      select tenant_id, buyer_ban, seq, v, min(seq) over (partition by tenant_id, buyer_ban) as first_seq,
             lag(v) over (partition by tenant_id, buyer_ban order by v, seq) as prev
      from (select tenant_id, buyer_ban, seq, cast(regexp_extract(invoice_number, '(\\d{6,})$', 1) as bigint) as v from inv) a) b) c
  group by 1,2,3) d group by tenant_id, buyer_ban having max(len) >= 3"""

_THRESH = """thr as (select tenant_id, total_amount as threshold from (
  select tenant_id, total_amount, row_number() over (partition by tenant_id order by total_amount desc) as rn,
         count(*) over (partition by tenant_id) as n from inv) z where rn = greatest(1, n // 4))"""

_CONTRACT2 = """
select tenant_id, min(seq) as seq, 0 as part,
  concat(buyer_ban, '(', cast(cast(round_even(cast(min_by(acc, seq) as double), 0) as bigint) as varchar), '/', cast(cast(min_by(c_commit, seq) as bigint) as varchar), 'x2)') as ref
from (select i.tenant_id, i.buyer_ban, i.seq, l.c_commit,
        sum(i.total_amount) over (partition by i.tenant_id, i.buyer_ban order by i.seq rows unbounded preceding) as acc
      from inv i join lastcon l on l.tenant_id=i.tenant_id and l.buyer_ban=i.buyer_ban where l.c_commit <> 0) z
where acc > 2*c_commit group by tenant_id, buyer_ban"""

_LEDGER = """select tenant_id, seq, 0 as part, concat('#', cast(seq as varchar), '(', cast(txn_date as varchar), ')') as ref
from (select *, lag(balance) over (partition by tenant_id order by seq) as prev from led) z where abs(prev + amount - balance) > 1"""

_JOINED = "select i.tenant_id, i.seq, 0 as part, i.invoice_number as ref from inv i join lastcon l on l.tenant_id=i.tenant_id and l.buyer_ban=i.buyer_ban where "
_INFO_CON = "case when n_con>0 then 'warning' else 'info' end"

CHECK_SQL = {
    "TAXID-01": _finding_sql("TAXID-01", _C1),
    "ARITH-01": _row_sql("ARITH-01", "abs(sales_amount+tax_amount-total_amount) > 1"),
    "ARITH-02": _row_sql("ARITH-02", "abs(tax_amount - round_even(cast(sales_amount*0.05 as double),0)) > 1.5"),
    "DATE-01": _row_sql("DATE-01", f"invoice_date > {AS_OF}"),
    "DATE-02": _row_sql("DATE-02", "due_date < invoice_date"),
    "DATE-03": _row_sql("DATE-03", "due_date - invoice_date > 365"),
    "AMT-01": _row_sql("AMT-01", "total_amount is null or total_amount <= 0"),
    "AMT-02": _row_sql("AMT-02", "tax_amount < 0"),
    "AMT-03": _row_sql("AMT-03", "total_amount > 50000000"),
    "FRAUD-01": _row_sql("FRAUD-01", "seller_ban = buyer_ban"),
    "DUP-01": _finding_sql("DUP-01", "select tenant_id, min(seq) as seq, 0 as part, invoice_number as ref from inv group by tenant_id, invoice_number having count(*) > 1"),
    "DUP-02": _finding_sql("DUP-02", "select tenant_id, min(seq) as seq, 0 as part, '' as ref from inv group by tenant_id, buyer_ban, total_amount, invoice_date having count(*) > 1", refs=False),
    "SEQ-01": _finding_sql("SEQ-01", _SEQ),
    "RELATED-01": _row_sql("RELATED-01", "seller_ban <> buyer_ban and substr(seller_ban,1,4) = substr(buyer_ban,1,4)"),
    "TERM-01": _row_sql("TERM-01", "abs(due_date - invoice_date - payment_terms_days) > 1"),
    "TERM-02": _finding_sql("TERM-02", _JOINED + "i.payment_terms_days <> l.c_terms", extra_cte=LASTCON, severity=_INFO_CON),
    "TERM-03": _finding_sql("TERM-03", _JOINED + "i.invoice_date < l.c_start", extra_cte=LASTCON, present="n_con>0"),
    "CONTRACT-01": _finding_sql("CONTRACT-01", """select i.tenant_id, i.seq, 0 as part, i.invoice_number as ref from inv i join thr on thr.tenant_id=i.tenant_id
        where i.total_amount >= threshold and exists (select 1 from con c where c.tenant_id=i.tenant_id)
        and not exists (select 1 from lastcon l where l.tenant_id=i.tenant_id and l.buyer_ban=i.buyer_ban)""", extra_cte=LASTCON + ",\n" + _THRESH, severity=_INFO_CON),
    "CONTRACT-02": _finding_sql("CONTRACT-02", _CONTRACT2, extra_cte=LASTCON, present="n_con>0"),
    "LEDGER-01": _finding_sql("LEDGER-01", _LEDGER, severity="case when n_led>=2 then 'critical' else 'info' end"),
}

RATIO_SQL = {
    "FORENSIC-01": ("count(*) filter (where sales_amount > 0 and sales_amount % 10000 = 0)", "count(*) filter (where sales_amount > 0)", 0.25, None),
    "FORENSIC-03": ("count(*) filter (where isodow(invoice_date) >= 6)", "count(invoice_date)", 0.20, "isodow(invoice_date) >= 6"),
    "RISK-02": (f"sum(case when status not in ('PAID','WRITTEN_OFF','CANCELLED','VOID') and due_date < {AS_OF} then total_amount else 0 end)",
                "sum(case when status not in ('PAID','WRITTEN_OFF','CANCELLED','VOID') then total_amount else 0 end)", 0.30,
                f"status not in ('PAID','WRITTEN_OFF','CANCELLED','VOID') and due_date < {AS_OF}"),
    "RISK-03": ("sum(case when status='WRITTEN_OFF' then total_amount else 0 end)", "sum(total_amount)", 0.03, "status='WRITTEN_OFF'"),
}


def _ratio_sql(check: str) -> str:
    num, den, limit, listed = RATIO_SQL[check]
    ratio = f"coalesce(cast({num} as double) / nullif(cast({den} as double), 0), cast({num} as double))"
    refs = f"""top as (select tenant_id, string_agg(invoice_number, ',' order by seq) as refs
        from (select *, row_number() over (partition by tenant_id order by seq) as rn from inv where {listed}) z where rn <= 20 group by tenant_id)""" \
        if listed else "top as (select null as tenant_id, null as refs)"
    return with_tables("inv", extra=f"g as (select tenant_id, {ratio} as r from inv group by tenant_id),\n" + refs) + f"""
select g.tenant_id, '{check}' as check_id, 'warning' as severity, r < {limit} as passed, round(r, 6) as measure, coalesce(top.refs,'') as refs
from g left join top on top.tenant_id = g.tenant_id"""


def _row_query(check: str):
    def run(spark, sf):
        inv, con, led = _load(spark, sf, [check])
        return C.findings(inv, con, led, D.AS_OF, [check]).drop("measure")
    return run


def _ratio_query(check: str):
    def run(spark, sf):
        inv, con, led = _load(spark, sf, [check])
        return C.findings(inv, con, led, D.AS_OF, [check]).withColumn("measure", F.round("measure", 6)).drop("n_flagged")
    return run


ORDER = list(C.CHECKS)
NUMBER = {"TAXID-01": 1, "ARITH-01": 2, "ARITH-02": 3, "DATE-01": 4, "DATE-02": 5, "DATE-03": 6, "AMT-01": 7, "AMT-02": 8, "AMT-03": 9,
          "FRAUD-01": 10, "DUP-01": 11, "DUP-02": 12, "SEQ-01": 13, "RELATED-01": 14, "TERM-01": 15, "TERM-02": 16, "TERM-03": 17,
          "CONTRACT-01": 18, "CONTRACT-02": 19, "BANK-01": 20, "LEDGER-01": 21, "FORENSIC-01": 22, "FORENSIC-02": 23, "FORENSIC-03": 24,
          "RISK-01": 25, "RISK-02": 26, "RISK-03": 27}


def _name(check: str) -> str:
    return f"C{NUMBER[check]:02d}_{check.replace('-', '_').lower()}"


for _k, _sql in CHECK_SQL.items():
    query(_name(_k), _sql)(_row_query(_k))
for _k in RATIO_SQL:
    query(_name(_k), _ratio_sql(_k))(_ratio_query(_k))

_CHI = " + ".join(f"power(d{k} - n*{__import__('math').log10(1 + 1 / k)!r}, 2)/(n*{__import__('math').log10(1 + 1 / k)!r})" for k in range(1, 10))
BENFORD_SQL = with_tables("inv", extra="b as (select tenant_id, cast(count(*) as double) as n, log10(cast(max(sales_amount) as double)/cast(min(sales_amount) as double)) as span, "
    + ", ".join(f"count(*) filter (where substr(cast(cast(floor(sales_amount) as bigint) as varchar),1,1)='{k}') as d{k}" for k in range(1, 10))
    + " from inv where sales_amount >= 10 group by tenant_id)") + f"""
select tenant_id, 'FORENSIC-02' as check_id, case when n>=50 and span>=1.5 then 'warning' else 'info' end as severity,
  case when n>=50 and span>=1.5 then {_CHI} < 15.507 else true end as passed,
  case when n>=50 and span>=1.5 then round({_CHI}, 4) else -1 end as measure from b"""


@query("C23_forensic_02", BENFORD_SQL)
def _benford(spark, sf):
    inv, con, led = _load(spark, sf, ["FORENSIC-02"])
    d = C.findings(inv, con, led, D.AS_OF, ["FORENSIC-02"])
    return d.select("tenant_id", "check_id", "severity", "passed", F.coalesce(F.round("measure", 4), F.lit(-1.0)).alias("measure"))


RISK1_SQL = with_tables("inv", extra="b as (select tenant_id, buyer_name, sum(total_amount) as amt, min(seq) as s from inv group by 1,2)") + """
select tenant_id, 'RISK-01' as check_id, buyer, round(cast(amt as double)/cast(total as double), 6) as measure, cast(amt as double)/cast(total as double) < 0.5 as passed
from (select tenant_id, buyer_name as buyer, amt, sum(amt) over (partition by tenant_id) as total,
       row_number() over (partition by tenant_id order by amt desc, s) as rn from b) z where rn = 1"""


@query("C25_risk_01", RISK1_SQL)
def _risk1(spark, sf):
    t = C.top_buyer(D.invoices(spark, sf))
    return t.select("tenant_id", F.lit("RISK-01").alias("check_id"), "buyer", F.round("share", 6).alias("measure"), (F.col("share") < 0.5).alias("passed"))


REF_SQL = with_tables("led", extra="""
i as (select tenant_id, invoice_number as ref, seq, row_number() over (partition by tenant_id, invoice_number order by seq) as k from inv where status='PAID'),
l as (select tenant_id, reference as ref, seq, row_number() over (partition by tenant_id, reference order by seq) as k from led where amount>0 and reference<>'')""") + """
select i.tenant_id, i.seq, l.seq as l_seq from i join l on l.tenant_id=i.tenant_id and l.ref=i.ref and l.k=i.k"""


# First-fit in input order: one step of the recursion gives every case's next open invoice the first inflow still free.
BANK_SQL = REF_SQL.split("select i.tenant_id")[0].replace("with ", "with recursive ", 1).rstrip() + """,
pr as materialized (select i.tenant_id, i.seq, l.seq as l_seq from i join l on l.tenant_id=i.tenant_id and l.ref=i.ref and l.k=i.k),
oi as materialized (select tenant_id, seq, invoice_number, cast(round(total_amount*100) as bigint) as cents, coalesce(paid_date, due_date) as day, case when paid_date is not null then 5 else 120 end as days,
  row_number() over (partition by tenant_id order by seq) as k from inv anti join pr using (tenant_id, seq) where status='PAID'),
ol as (select tenant_id, seq as l_seq, cast(round(amount*100) as bigint) as cents, txn_date as day from (select * exclude (seq), seq as l_seq, seq from led) anti join pr using (tenant_id, l_seq) where amount>0),
cand as materialized (select oi.tenant_id, k, l_seq from oi join ol on ol.tenant_id=oi.tenant_id and abs(ol.cents-oi.cents)<=100
  and (oi.day is null or ol.day is null or abs(date_diff('day', oi.day, ol.day))<=oi.days)),
fit as (select distinct tenant_id, cast(0 as bigint) as k, cast([] as bigint[]) as used, cast(null as bigint) as l_seq from oi union all
  select f.tenant_id, f.k+1, case when min(c.l_seq) is null then any_value(f.used) else list_append(any_value(f.used), min(c.l_seq)) end, min(c.l_seq)
  from fit f join oi on oi.tenant_id=f.tenant_id and oi.k=f.k+1 left join cand c on c.tenant_id=f.tenant_id and c.k=f.k+1 and not list_contains(f.used, c.l_seq) group by f.tenant_id, f.k),
viol as (select oi.tenant_id, oi.seq, oi.invoice_number as ref from oi join fit on fit.tenant_id=oi.tenant_id and fit.k=oi.k where fit.l_seq is null and oi.tenant_id in (select tenant_id from led)),
cnt as (select tenant_id, count(*) as n from viol group by 1),
top as (select tenant_id, string_agg(ref, ',' order by seq) as refs from (select *, row_number() over (partition by tenant_id order by seq) as rn from viol) z where rn <= 20 group by 1),
paid as (select tenant_id, count(*) as n_paid from inv where status='PAID' and tenant_id in (select tenant_id from led) group by 1)
select b.tenant_id, 'BANK-01' as check_id, case when b.tenant_id in (select tenant_id from led) then 'critical' else 'info' end as severity, cnt.n is null as passed, coalesce(cnt.n, 0) as n_flagged,
  round(1 - coalesce(cnt.n, 0) / greatest(n_paid, 1), 6) as measure, coalesce(top.refs, '') as refs
from (select distinct tenant_id from inv) b left join cnt using (tenant_id) left join top using (tenant_id) left join paid using (tenant_id)"""


@query("C20_bank_01", BANK_SQL)
def _bank(spark, sf):
    inv, con, led = _load(spark, sf, ["BANK-01"])
    return C.findings(inv, con, led, D.AS_OF, ["BANK-01"]).withColumn("measure", F.round("measure", 6))


@query("C20_bank_01_by_reference", REF_SQL)
def _bank_ref(spark, sf):
    from ..operators.reconcile import by_reference
    return by_reference(D.invoices(spark, sf), D.ledger(spark, sf))


# Every check but BANK-01, combined; queries named ..._with_bank have all of them.
def _score_parts() -> str:
    parts = []
    for k, sql in {**CHECK_SQL, **{c: _ratio_sql(c) for c in RATIO_SQL}, "FORENSIC-02": BENFORD_SQL, "RISK-01": RISK1_SQL}.items():
        sev = "'warning' as severity" if k == "RISK-01" else "severity"
        parts.append(f"select tenant_id, check_id, {sev}, passed from ({sql}) q_{k.replace('-', '_')}")
    return " union all ".join(parts)


FOUND_SQL = f"found as ({_score_parts()} union all select tenant_id, check_id, severity, passed from ({BANK_SQL}) q_bank)"

SCORE_SQL = with_tables("inv", "con", "led", extra=FOUND_SQL) + """
select b.tenant_id, b.n as n_invoices, coalesce(c.n,0) as n_contracts, coalesce(l.n,0) as n_ledger, n_checks, n_failed,
  cast(round_even(cast(earned as double)/greatest(possible,1), 3) as double) as integrity_score, critical_failures, critical_failures = 0 as submission_ready
from (select tenant_id, count(*) as n from inv group by 1) b
left join (select tenant_id, count(*) as n from con group by 1) c on c.tenant_id=b.tenant_id
left join (select tenant_id, count(*) as n from led group by 1) l on l.tenant_id=b.tenant_id
join (select tenant_id, count(*) as n_checks, count(*) filter (where not passed) as n_failed,
        sum(case when passed then w else 0 end) as earned, sum(w) as possible,
        count(*) filter (where not passed and severity='critical') as critical_failures
      from (select *, case severity when 'critical' then 3 when 'warning' then 1 else 0 end as w from found) f group by 1) g on g.tenant_id=b.tenant_id"""


@query("C28_scorecard", SCORE_SQL)
def scorecard(spark, sf):
    inv, con, led = _load(spark, sf)
    return C.scorecard(C.findings(inv, con, led, D.AS_OF, C.VERDICTS), C.count_documents(inv, con, led))


_GROUP_CASE = "case " + " ".join(f"when split_part(check_id,'-',1) in ({','.join(repr(p) for p in ps)}) then '{g}'" for g, ps in C.CHECK_GROUPS.items()) + " else 'other' end"


GROUP_SQL = with_tables("inv", "con", "led", extra=FOUND_SQL) + f"""
select tenant_id, {_GROUP_CASE} as check_group,
  case max(case when passed then 0 when severity='critical' then 2 else 1 end) when 2 then 'critical' when 1 then 'warning' else 'good' end as status,
  count(*) filter (where passed) as n_passed, count(*) as n_total from found group by 1, 2"""


@query("C29_group_rollup", GROUP_SQL)
def _groups(spark, sf):
    inv, con, led = _load(spark, sf)
    return C.group_rollup(C.findings(inv, con, led, D.AS_OF, C.VERDICTS))


# Questions of the case desk, spread over the cases: a fixed phrase per case decides what is asked.
PHRASES = ["金額算術哪裡不對", "重複請款有幾筆", "FORENSIC 有沒有問題", "逾期和呆帳", "天氣如何"]


FOCUS_SQL = with_tables("inv", "con", "led", extra=FOUND_SQL + """,
q as (select 'Q-' || tenant_id as question_id, tenant_id,
  case cast(substr(tenant_id,6) as bigint) % 5 """ + " ".join(
    f"when {i} then '{'|'.join(p for p, ws in C.CHECK_ALIASES.items() if p.lower() in t.lower() or any(w in t for w in ws))}'" for i, t in enumerate(PHRASES)) + """ end as asked
  from (select distinct tenant_id from inv) z)""") + """
select question_id, q.tenant_id, check_id, case when list_contains(string_split(asked,'|'), split_part(check_id,'-',1)) then 0 else 1 end as tier, severity, passed
from q join found f on f.tenant_id=q.tenant_id where list_contains(string_split(asked,'|'), split_part(check_id,'-',1)) or not passed"""


@query("C30_focus_findings", FOCUS_SQL)
def _focus(spark, sf):
    inv, con, led = _load(spark, sf)
    t = inv.select("tenant_id").distinct()
    q = t.select(F.concat(F.lit("Q-"), "tenant_id").alias("question_id"), "tenant_id",
                 F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.substring("tenant_id", 6, 20).cast("bigint") % 5 + 1).cast("int")).alias("q"))
    return C.focus_findings(q, C.findings(inv, con, led, D.AS_OF, C.VERDICTS)).drop("n_flagged")

