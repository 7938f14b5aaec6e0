"""Registered queries on questions, screening and governance (Q, G, F2, M8, F4, E5, E7)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.text import largest_amount
from ..operators import checks, evidence as E, governance as G, questions as Q
from ..sources import driver_tables as D
from . import texts as X
from .case_checks import BANK_SQL, CHECK_SQL
from .adapters_sql import with_tables
from .registry import query


def _has(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


# Labels of statistic rows: brands as Chinese category names, next to names that are no category.
def labels(spark, sf):
    p = D.table(spark, sf, "part")
    brand = p.select(F.concat(F.lit("品牌"), F.substring("p_brand", 7, 2), F.lit("製造業")).alias("label"))
    wide = p.select(F.concat(F.lit("品牌"), F.substring("p_brand", 7, 2), F.lit("製造業產業")).alias("label"))
    other = p.select("p_type").union(p.select(F.col("p_size").cast("string"))).union(p.select(F.lit("合計"))).toDF("label")
    return brand.union(wide).union(other)


LABELS_SQL = """labels as (select concat('品牌', substr(p_brand,7,2), '製造業') as label from part union all select concat('品牌', substr(p_brand,7,2), '製造業產業') from part union all select p_type from part
  union all select cast(p_size as varchar) from part union all select '合計' from part)"""


def meaningful(label):
    """A row label that can show which category a question means: 3-30 characters, not generic, not digits or dates only,
    at least two Chinese characters."""
    # Labels too general to mean a category.
    generic = ["合計", "總計", "小計", "平均", "其他", "未分類", "不詳", "全體", "總和", "年", "月", "季", "合計數", "nan", "None"]
    return (F.length(label).between(3, 30) & ~label.isin(generic) & ~F.rlike(label, F.lit(r"^[0-9\s.,\-/年月季]+$"))
            & (F.regexp_count(label, F.lit("[㐀-䶿一-鿿]")) >= 2))


OK_SQL = r"(length(label) between 3 and 30 and label not in ('合計','總計','小計','平均','其他','未分類','不詳','全體','總和','年','月','季','合計數') and not regexp_full_match(label, '[0-9\s.,\-/年月季]+') and len(regexp_extract_all(label, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]'))>=2)"


@query("F4_label_filter", f"with {LABELS_SQL} select label, count(*) as n, {OK_SQL} as ok from labels group by 1")
def _labels(spark, sf):
    return labels(spark, sf).groupBy("label").agg(F.count("*").alias("n")).withColumn("ok", meaningful(F.col("label")))


def asked_about(spark, sf):
    q = X.asked(spark, sf)
    return q.withColumn("q", F.concat(F.lit("品牌"), (11 + 11 * (F.col("query_id") % 5)).cast("string"), F.lit("製造業產業 "), "q"))


ABOUT_SQL = X.ASKED_SQL + ", about as (select query_id, tenant_id, role, concat('品牌', cast(11+11*(query_id%5) as varchar), '製造業產業 ', q) as q from asked)"
_THIRD = _has("s", Q.THIRD_PARTIES)
_ROUTE = " union all ".join(
    f"select query_id, '{k}' as metric from sq where {_has('s', ws)}" + (f" and not {_THIRD}" if k in Q.CASE_SCOPED else "") for k, ws in Q.ROUTES.items())


@query("Q1_routing", f"""with {LABELS_SQL}, {ABOUT_SQL}, sq as (select query_id, regexp_replace(q, '\\s+', '', 'g') as s from about),
lab as (select distinct label from labels where {OK_SQL}) {_ROUTE}
union all select distinct query_id, 'statistics' from sq join lab on contains(s, label)
union all select distinct query_id, 'industry' from sq join lab on contains(s, label) where {_has('s', Q.INDUSTRY_WORDS)}""")
def _route(spark, sf):
    lab = labels(spark, sf).where(meaningful(F.col("label"))).distinct()
    return Q.route(asked_about(spark, sf), lab, lab)


@query("N7_question_labels", f"""with {LABELS_SQL}, {ABOUT_SQL}, sq as (select query_id, regexp_replace(q, '\\s+', '', 'g') as s from about),
lab as (select distinct label from labels where {OK_SQL}), hit as (select query_id, label from sq join lab on contains(s, label))
select query_id, label, place from (select *, row_number() over (partition by query_id order by length(label) desc, label) as place from hit h
  where not exists (select 1 from hit o where o.query_id=h.query_id and length(o.label)>length(h.label) and contains(o.label, h.label))) z where place<=3""")
def _qlabels(spark, sf):
    return Q.label_matches(asked_about(spark, sf), labels(spark, sf).where(meaningful(F.col("label"))))


_AD, _ROC, _ART, _VER = (p.replace("(?:", "(?:") for p in (Q.AD_YEAR, Q.ROC_YEAR, Q.ARTICLE, Q.VERSION_HINT))
_CORE = "q"
for _p in (_AD, _ROC, _ART, _VER):
    _CORE = f"regexp_replace({_CORE}, '{_p}', ' ', 'g')"
for _ws in Q.JURISDICTIONS.values():
    for _w in sorted(_ws, key=len, reverse=True):
        _CORE = f"replace({_CORE}, '{_w}', ' ')"
_CORE = f"trim(regexp_replace({_CORE}, '\\s+', ' ', 'g'))"
_YEARS = f"""list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(q, '{_AD}', 1), lambda y: cast(y as int)),
  list_transform(list_filter(regexp_extract_all(q, '{_ROC}', 1), lambda y: cast(y as int) between 60 and 200), lambda y: cast(y as int)+1911))))"""


@query("Q2_decompose", f"with {X.ASKED_SQL} select query_id, array_to_string({_YEARS}, ',') as years, array_to_string(regexp_extract_all(q, '{_ART}'), ',') as articles, case when {_CORE}='' then q else {_CORE} end as core from asked")
def _decompose(spark, sf):
    return Q.decompose(X.asked(spark, sf))


def nodes(spark, sf):
    """Graph nodes to link to: documents by source name, topics, and the label nodes."""
    d = D.table(spark, sf, "documents").select(F.lit("document").alias("node_type"), F.col("source").alias("label")).distinct()
    t = D.table(spark, sf, "region").select(F.lit("topic").alias("node_type"), F.explode(F.array(*[F.lit(x) for x in Q.TOPICS])).alias("label")).distinct()
    i = labels(spark, sf).where(meaningful(F.col("label"))).select(F.lit("industry").alias("node_type"), "label").distinct()
    return d.union(t).union(i)


_TOPICS = ",".join(f"'{t}'" for t in Q.TOPICS)
NODES_SQL = f"""nodes as (select distinct 'document' as node_type, source as label from documents union all select 'topic', unnest([{_TOPICS}]) union all select distinct 'industry', label from labels where {OK_SQL})"""
_ALIAS = " union all ".join(
    f"select query_id, 'jurisdiction' as node_type, '{j}' as label, case " + " ".join(f"when contains(q,'{w}') then '{'exact' if w == j else 'alias'}'" for w in sorted(ws, key=len, reverse=True)) + f" end as via from linkq where {_has('q', ws)}"
    for j, ws in Q.JURISDICTIONS.items())
LINKQ_SQL = ABOUT_SQL + ", linkq as (select query_id, concat(q, ' ', role, ' ', (select min(source) from documents)) as q from about)"
LINK_SQL = f"""link as ({_ALIAS} union all select distinct query_id, node_type, label, 'exact' from linkq join nodes on length(label)>=2 and contains(q, label)
  where not (node_type='jurisdiction'))"""


def linkq(spark, sf):
    first = D.table(spark, sf, "documents").agg(F.min("source").alias("s"))
    return asked_about(spark, sf).join(F.broadcast(first)).select("query_id", F.concat_ws(" ", "q", "role", "s").alias("q"))  # one row


@query("Q3_entity_links", f"with {LABELS_SQL}, {LINKQ_SQL}, {NODES_SQL}, {LINK_SQL} select query_id, node_type, label, via from link")
def _links(spark, sf):
    return Q.link_entities(linkq(spark, sf), nodes(spark, sf))


@query("Q4_filter_plan", f"""with {LABELS_SQL}, {LINKQ_SQL}, {NODES_SQL}, {LINK_SQL} select a.query_id, coalesce(s,'') as sources, coalesce(f,'') as foreign_advice,
  len(regexp_extract_all(q,'{_AD}'))>0 or len(list_filter(regexp_extract_all(q,'{_ROC}',1), lambda y: cast(y as int) between 60 and 200))>0 as year_advice, len(regexp_extract_all(q,'{_ART}'))>0 as article_advice
from linkq a left join (select query_id, string_agg(distinct label, ',' order by label) filter (where node_type='document') as s, string_agg(distinct label, ',' order by label) filter (where node_type='jurisdiction' and label<>'台灣') as f from link group by 1) l on l.query_id=a.query_id""")
def _plan(spark, sf):
    q = linkq(spark, sf)
    return Q.filter_plan(Q.link_entities(q, nodes(spark, sf)), q)


def _screen_sql() -> str:
    t = r"regexp_replace(nfc_normalize(q), '\s+', '', 'g')"
    cols = []
    for name, (_, pats) in Q.SCREEN.items():
        hits = []
        for p in pats:
            h = f"regexp_matches(t, '(?i){p}')"
            if name == "CROSS_TENANT":
                h = f"({h} and not contains(regexp_extract(t, '(?i)({p})', 1), tenant_id))"
            hits.append(h)
        cols.append(f"case when {' or '.join(hits)} then '{name}' end")
    return f"""with {X.ASKED_SQL}, s as (select query_id, tenant_id, {t} as t from asked), r as (select query_id, list_filter([{', '.join(cols)}], lambda x: x is not null) as rules from s)
select query_id, array_to_string(rules, ',') as rules, case when list_has_any(rules, ['CROSS_TENANT','INJECTION','MALICIOUS']) then 'block' when len(rules)>0 then 'flag' else 'ok' end as severity from r"""


@query("Q5_request_screen", _screen_sql())
def _screen(spark, sf):
    return Q.screen_requests(X.asked(spark, sf)).select("query_id", "rules", "severity")


@query("Q6_output_leak", "with a as (select conv_id*1000000+turn as query_id, case when conv_id%9=0 then concat(text,' tenant_id = 5') when conv_id%9=1 then concat('PostgreSQL://x ', text) else text end as answer from conversations) select query_id, regexp_matches(answer, '(?i)(你是一位資深的中小企業供應鏈融資顧問|【回答規則|tenant_id\\s*=|postgresql://)') as leak from a")
def _leak(spark, sf):
    c = D.table(spark, sf, "conversations")
    m = F.col("conv_id") % 9
    a = F.when(m == 0, F.concat("text", F.lit(" tenant_id = 5"))).when(m == 1, F.concat(F.lit("PostgreSQL://x "), "text")).otherwise(F.col("text"))
    return c.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("query_id"), Q.leaks(a).alias("leak"))


_RED = "txt"
_RED = f"regexp_replace({_RED}, '\\b([0-9]{{3}})[0-9]{{5}}\\b', '\\1*****', 'g')"
for _sep in ("", "[-\\s]"):
    for _area in (1, 2):
        for _n in (6, 7, 8):
            _rest = 1 + _area + (1 if _sep else 0) + _n - 3
            _inner = (f"(0[0-9]{{2}})[0-9]{{{_n}}}" if not _sep and _area == 2 else f"(0[0-9][0-9])[0-9]{{{_n - 1}}}" if not _sep else f"(0[0-9]{{2}}){_sep}[0-9]{{{_n}}}" if _area == 2 else f"(0[0-9]{_sep})[0-9]{{{_n}}}")
            _RED = f"regexp_replace({_RED}, '\\b{_inner}\\b', '\\1{'*' * _rest}', 'g')"
for _n in range(10, 17):
    _RED = f"regexp_replace({_RED}, '\\b([0-9]{{3}})[0-9]{{{_n - 3}}}\\b', '\\1{'*' * (_n - 3)}', 'g')"
_RED = f"regexp_replace({_RED}, '\\b([A-Za-z0-9_.+-]{{2}})[A-Za-z0-9_.+-]*@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.]+\\b', '\\1***@***', 'g')"
_RED = f"regexp_replace({_RED}, '\\b([A-Za-z0-9_.+-]@)[A-Za-z0-9_-]+\\.[A-Za-z0-9_.]+\\b', '\\1***@***', 'g')"


@query("Q7_redact", f"select query_id, {_RED} as redacted from (select conv_id*1000000+turn as query_id, concat('id ', cast(10000000+conv_id*7919 as varchar), ' tel 0', cast(2+turn%7 as varchar), '-', cast(2000000+conv_id as varchar), ' acc ', cast(100000000000+conv_id*104729 as varchar), ' mail user.', role, '@mail.example.com or a@b.com tel 02', chr(9), '27208889 ', text) as txt from conversations) z")
def _redact(spark, sf):
    c = D.table(spark, sf, "conversations")
    t = F.concat(F.lit("id "), (F.lit(10000000) + F.col("conv_id") * 7919).cast("string"), F.lit(" tel 0"), (2 + F.col("turn") % 7).cast("string"), F.lit("-"),
                 (F.lit(2000000) + F.col("conv_id")).cast("string"), F.lit(" acc "), (F.lit(100000000000) + F.col("conv_id") * 104729).cast("string"), F.lit(" mail user."), "role", F.lit("@mail.example.com or a@b.com tel 02\t27208889 "), F.col("text"))
    return c.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("query_id"), Q.redact(t).alias("redacted"))


def access_log(spark, sf):
    return D.table(spark, sf, "events").select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("tenant_id"), "ts")


@query("Q8_query_rate", """select event_id, actor, tenant_id, n_recent from (select event_id, user_id as actor, event_type as tenant_id,
  count(*) over (partition by user_id, event_type order by ts range between interval 36000 second preceding and current row) as n_recent from events) z where n_recent > 3""")
def _rate(spark, sf):
    return Q.rate_anomalies(access_log(spark, sf), 36000, 3).select("event_id", "actor", "tenant_id", "n_recent")


@query("Q9_simplified", f"with {X.ASKED_SQL} select query_id, s as n_simplified, case when c=0 then 1.0 else round(1-s/c, 6) end as purity from (select query_id, len(regexp_extract_all(q,'[{Q.SIMPLIFIED}]')) as s, len(regexp_extract_all(q,'[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]')) as c from asked) z")
def _simplified(spark, sf):
    s, p = Q.simplified_purity(F.col("q"))
    return X.asked(spark, sf).select("query_id", s.alias("n_simplified"), F.round(p, 6).alias("purity"))


@query("Q10_byte_repair", f"with {X.ASKED_SQL} select query_id, concat('<0xFF><0xE8><0xB3><0x87> ', replace(q, '<0xE8><0xB3><0x87>', '資'), ' 資') as repaired from asked")
def _bytes(spark, sf):
    q = F.concat(F.lit("<0xFF><0xE8><0xB3><0x87> "), F.col("q"), F.lit(" <0xE8><0xB3><0x87>"))  # a run that is not valid stays whole
    return X.asked(spark, sf).select("query_id", Q.repair_bytes(q).alias("repaired"))


_AMT = r"((?:NT\$|新台幣|台幣)?\s*[0-9][0-9,]{4,}\s*(?:萬元|元|萬|億)?)"


@query("M8_amount_review", f"""with {X.ASKED_SQL} select query_id, coalesce(list_max(list_transform(regexp_extract_all(q, '{_AMT}'), lambda m: try_cast(replace(regexp_extract(m, '([0-9][0-9,]{{4,}})', 1), ',', '') as double)
  * case when contains(m,'億') then 1e8 when contains(m,'萬') then 1e4 else 1.0 end)), 0.0) as amount, amount >= 5000000 as needs_review from asked""")
def _amount(spark, sf):
    a = largest_amount(F.col("q"))
    return X.asked(spark, sf).select("query_id", a.alias("amount"), (a >= E.REVIEW_AMOUNT).alias("needs_review"))


@query("E7_scope_terms", f"""with {X.ASKED_SQL}, {X.CHUNKS_SQL} select query_id, array_to_string(list_concat(list_filter([{",".join(f"case when contains(q,'{w}') then '{w}' end" for w in E.FOREIGN)}], lambda x: x is not null),
 list_transform(regexp_extract_all(q, '(?:民國\\s*)?([0-9]{{2,4}})\\s*年', 1), lambda y: y || '年'), list_transform(regexp_extract_all(q, '第\\s*([一二三四五六七八九十百0-9]+)\\s*條', 1), lambda a: '第' || a || '條')), ',') as terms from asked""")
def _scope(spark, sf):
    return X.asked(spark, sf).select("query_id", E.scope_terms(F.col("q")).alias("terms"))


# Answers that state ratios, payment days and ids of their case.
def stated(spark, sf):
    c = D.table(spark, sf, "conversations")
    n = F.col("conv_id") * 7 + F.col("turn")
    ratio = F.element_at(F.array(F.lit("九成"), F.lit("百分之八十五"), F.lit("90%"), F.lit("百分之十")), (n % 4 + 1).cast("int"))
    text = F.concat(F.lit("保證成數為"), ratio, F.lit("，付款條件 "), (30 + 15 * (n % 5)).cast("string"), F.lit(" 天。統編 "), (F.lit(20000000) + ((F.col("conv_id") % 100) * 7919) % 79999999).cast("string"),
                    F.when(n % 6 == 0, F.lit("，成數 七成")).otherwise(""), F.when(n % 5 == 0, F.lit("，建議送件 ")).otherwise(" "), "text")
    return c.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("answer_id"), F.format_string("CASE-%04d", (F.col("conv_id") % 120).cast("bigint")).alias("tenant_id"), text.alias("answer"), n.alias("n"))


STATED_SQL = """stated as (select conv_id*1000000+turn as answer_id, conv_id*7+turn as n, printf('CASE-%04d', conv_id%120) as tenant_id, cast(20000000+((conv_id%100)*7919)%79999999 as varchar) as ban from conversations),
asserted as (select answer_id, tenant_id, 'guarantee_ratio' as kind, printf('%.6f', ([0.9,0.85,0.9,0.1])[n%4+1]) as value from stated union all select answer_id, tenant_id, 'guarantee_ratio', '0.700000' from stated where n%6=0
  union all select answer_id, tenant_id, 'payment_terms', cast(30+15*(n%5) as varchar) from stated union all select answer_id, tenant_id, 'tax_id', ban from stated)"""


@query("E5_assertions", f"with {STATED_SQL} select answer_id, kind, value from asserted")
def _assert(spark, sf):
    return E.assertions(stated(spark, sf), ["answer_id"], "answer")


CRITICAL = [k for k, (severity, _) in checks.CHECKS.items() if severity == "critical"]

AUDIT_SQL = with_tables("inv", "con", "led", extra=STATED_SQL + """,
bad as (select distinct tenant_id from (""" + " union all ".join(f"select tenant_id, passed from ({CHECK_SQL[k]}) q" for k in CRITICAL if k in CHECK_SQL) + f""" union all select tenant_id, passed or severity <> 'critical' from ({BANK_SQL}) q_bank) c where not passed), cases as (select distinct tenant_id from inv),
terms as (select tenant_id, cast(payment_terms_days as varchar) as v from inv union select tenant_id, cast(payment_terms_days as varchar) from con),
known as (select tenant_id, buyer_ban as v from inv union select tenant_id, seller_ban from inv),
aud as (select answer_id, 'AUD-01' as audit_id, 'contradiction' as severity, value from asserted a where kind='payment_terms' and tenant_id in (select tenant_id from cases) and not exists (select 1 from terms t where t.tenant_id=a.tenant_id and t.v=value)
 union all select answer_id, 'AUD-02', 'unsupported', value from asserted a where kind='tax_id' and tenant_id in (select tenant_id from cases) and not exists (select 1 from known t where t.tenant_id=a.tenant_id and t.v=value)
 union all select answer_id, 'AUD-03', 'contradiction', cast(count(distinct value) as varchar) from asserted where kind='guarantee_ratio' group by 1 having count(distinct value)>1
 union all select answer_id, 'AUD-04', 'contradiction', '建議送件' from stated where n%5=0 and tenant_id in (select tenant_id from bad))""")


def _audit(spark, sf):
    inv, con = D.invoices(spark, sf), D.contracts(spark, sf)
    bad = checks.findings(inv, con, D.ledger(spark, sf), D.AS_OF, CRITICAL).where("severity = 'critical' and not passed").select("tenant_id").distinct()
    a = stated(spark, sf)
    return a, E.audit_answers(a, inv, con, bad)


query("E13_answer_audit", AUDIT_SQL + "select * from aud")(lambda spark, sf: _audit(spark, sf)[1])
RELEASABLE_SQL = "select s.answer_id, coalesce(a.n,0) as contradictions, a.n is null as releasable from stated s left join (select answer_id, count(*) as n from aud where severity='contradiction' group by 1) a on a.answer_id=s.answer_id"
query("E13_releasable", AUDIT_SQL + RELEASABLE_SQL)(lambda spark, sf: E.releasable(*_audit(spark, sf)))

# ---- governance ------------------------------------------------------------------------------------------------------
AS_OF = dt.date(2024, 1, 15)
ACCESS_SQL = """principals as (select distinct user_id, case when user_id%3=0 then 'reviewer' else 'officer' end as role, case when user_id%10=0 then 'disabled' else 'active' end as status from events),
grants as (select distinct user_id, event_type as tenant_id, case when user_id%2=0 then 'write' else 'read' end as access_level, case when user_id%7=0 then date '2024-01-10' when user_id%7=1 then date '2024-02-01' end as expires_at,
  case when user_id%11=0 then date '2024-01-01' end as revoked_at from events where value > 20),
access as (select p.user_id, role, g.tenant_id, access_level from principals p join grants g on g.user_id=p.user_id where status='active' and revoked_at is null and (expires_at is null or expires_at>date '2024-01-15')
  union all select user_id, role, 'SHARED', 'read' from principals where status='active')"""


def _access(spark, sf):
    e = D.table(spark, sf, "events")
    u = F.col("user_id")
    p = e.select("user_id", F.when(u % 3 == 0, "reviewer").otherwise("officer").alias("role"), F.when(u % 10 == 0, "disabled").otherwise("active").alias("status")).distinct()
    day = lambda s: F.lit(s).cast("date")
    g = e.where("value > 20").select("user_id", F.col("event_type").alias("tenant_id"), F.when(u % 2 == 0, "write").otherwise("read").alias("access_level"),
                                     F.when(u % 7 == 0, day("2024-01-10")).when(u % 7 == 1, day("2024-02-01")).alias("expires_at"), F.when(u % 11 == 0, day("2024-01-01")).alias("revoked_at")).distinct()
    return G.effective_access(p, g, AS_OF)


query("G3_effective_access", f"with {ACCESS_SQL} select * from access")(_access)


@query("F2_tenant_scope", f"with {ACCESS_SQL} select a.user_id, count(*) as n_rows, round(sum(value),2) as total from access a join events e on e.event_type=a.tenant_id group by 1")
def _scope_rows(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("event_type").alias("tenant_id"), "value")
    per = e.groupBy("tenant_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    return G.visible_rows(per, _access(spark, sf)).groupBy("user_id").agg(F.sum("n").alias("n_rows"), F.round(F.sum("v"), 2).alias("total"))


@query("G2_isolation", with_tables("inv", extra="p as (select distinct tenant_id as tenant_a, printf('CASE-%04d', cast(substr(tenant_id,6) as bigint)+1) as tenant_b from inv)") + """
select tenant_a, tenant_b, coalesce(n,0) as b_rows, 0 as leaked, case when n is null then 'inconclusive' else 'passed' end as state from p left join (select tenant_id, count(*) as n from inv group by 1) i on i.tenant_id=tenant_b""")
def _isolation(spark, sf):
    inv = D.invoices(spark, sf).select("tenant_id")
    t = inv.distinct()
    nxt = F.format_string("CASE-%04d", (F.substring("tenant_id", 6, 20).cast("bigint") + 1).cast("bigint"))
    pairs = t.select(F.col("tenant_id").alias("tenant_a"), nxt.alias("tenant_b"))
    # what each viewer's session sees: the rows of its own case
    own = t.select(F.col("tenant_id").alias("viewer"), "tenant_id")
    return G.isolation(inv, inv.join(own, "tenant_id").select("viewer", "tenant_id"), pairs)


SEGMENT = 1000


def audit_log(spark, sf):
    """One hash chain per conversation segment; in every seventh conversation the third entry was altered afterwards."""
    c = D.table(spark, sf, "conversations").withColumn("chain_id", F.concat_ws("-", "conv_id", F.floor(F.col("turn") / SEGMENT).cast("string")))
    g = c.groupBy("chain_id", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))  # at most SEGMENT turns
    link = lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(G.GENESIS)), x["role"], x["text"]), 256)))
    g = g.withColumn("h", F.aggregate("t", F.array().cast("array<string>"), link))
    d = g.select("chain_id", "conv_id", F.posexplode("t").alias("i", "x"), "h")
    altered = (F.col("conv_id") % 7 == 0) & (F.col("x.turn") == 2)
    return d.select("chain_id", F.col("x.turn").alias("id"), F.col("x.role").alias("role"), F.when(altered, F.concat("x.text", F.lit("!"))).otherwise(F.col("x.text")).alias("text"),
                    F.when(F.col("i") == 0, G.GENESIS).otherwise(F.element_at("h", F.greatest(F.col("i"), F.lit(1)))).alias("prev_hash"), F.element_at("h", F.col("i") + 1).alias("row_hash"))


@query("G1_audit_chain", "select concat(cast(conv_id as varchar), '-', cast(turn//1000 as varchar)) as chain_id, count(*) as n_rows, count(*) filter (where conv_id%7=0 and turn=2)=0 as intact, coalesce(min(turn) filter (where conv_id%7=0 and turn=2), -1) as break_at from conversations group by 1")
def _chain(spark, sf):
    return G.verify_chain(audit_log(spark, sf), ["role", "text"]).withColumn("break_at", F.coalesce("break_at", F.lit(-1)))
