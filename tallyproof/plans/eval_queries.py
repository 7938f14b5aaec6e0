"""Registered evaluation queries (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C, evaluate as V, questions as Q
from ..session import written
from ..sources import driver_tables as D
from . import texts as X
from .adapters_sql import with_tables
from .case_checks import FOUND_SQL
from .registry import query

FIELDS = ["quality", "total_amount", "issue_date", "lead"]


def _gold_pred(spark, sf, shift: int = 0):
    """Gold and predictions over the labelled documents for two models; ``shift`` moves who is wrong where."""
    k = F.col("doc_id")
    d = D.table(spark, sf, "labels").join(D.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    num, day = k * 37 + 1000, k % 28 + 1
    lead = F.col("text")
    gold = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("gold")) for f, v in [
        ("quality", F.col("quality").cast("string")), ("total_amount", F.when(k % 13 != 0, F.concat(F.lit("NT$"), F.format_number(num, 2)))),
        ("issue_date", F.concat(F.lit("2024-01-"), day.cast("string"))), ("lead", lead)]])
    models = d.withColumn("m", F.explode(F.array(F.lit(1), F.lit(2))))
    wrong = ((k + shift) % (3 + F.col("m") * 2)) == 0
    blank = k % 10 == 3
    val = [("quality", F.when(blank, "N/A").when(wrong, (1 - F.col("quality")).cast("string")).otherwise(F.col("quality").cast("string"))),
           ("total_amount", F.when(blank, "unknown").otherwise(F.concat((num + F.when(wrong, 1).otherwise(0)).cast("string"), F.lit(" 元")))),
           ("issue_date", F.when(blank, "").when(wrong, F.concat(day.cast("string"), F.lit("/2/2024"))).when(F.col("m") == 1, F.concat(day.cast("string"), F.lit("/1/2024"))).otherwise(F.concat(day.cast("string"), F.lit(" Jan 2024")))),
           ("lead", F.when(wrong, F.lit("zzqq")).otherwise(F.concat(F.lit("  "), lead, F.lit(" ."))))]
    pred = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value"), F.lit(i).alias("i")) for i, (f, v) in enumerate(val)])
    p = models.select(F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("dataset"), F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), "doc_id", "m", "text", F.explode(pred).alias("p"))
    p = p.select("dataset", "model", "doc_id", "p.field", "p.value", ((k * 37 + F.col("m") * 11 + F.col("p.i") * 7) % 100 / 100).alias("confidence"),
                 F.when(F.col("p.field") == "lead", 0).alias("span_start"), F.when(F.col("p.field") == "lead", F.length("text")).alias("span_end"))
    g = d.select("doc_id", F.explode(gold).alias("g")).select("doc_id", "g.*")
    return p, g, d.select("doc_id", "text")


def outcomes(spark, sf, shift: int = 0):
    return written(spark, sf, f"outcomes{shift}", lambda: V.field_outcomes(*_gold_pred(spark, sf, shift)))


def _norm(c):
    return f"regexp_replace(lower(trim(regexp_replace(nfc_normalize({c}), '\\s+', ' ', 'g'))), '[.,;:]+$', '')"


def out_sql(shift: int = 0, name: str = "o") -> str:
    lead, v = _norm("text"), _norm("case when wrong then 'zzqq' else '  ' || text || ' .' end")
    return f"""{name}_d as (select l.doc_id, case when toxic=1 then 'toxic' else 'clean' end as dataset, m, concat('m',cast(m as varchar)) as model, f.field, f.i, text, quality, (l.doc_id+{shift})%(3+m*2)=0 as wrong, l.doc_id%10=3 as blank
  from labels l join documents using(doc_id) cross join (select unnest([1,2]) as m) mm cross join (select unnest(['quality','total_amount','issue_date','lead']) as field, unnest([0,1,2,3]) as i) f),
{name} as (select dataset, model, doc_id, field, ((doc_id*37+m*11+i*7)%100)/100.0::double as confidence,
  case when field<>'lead' and blank then case when field='total_amount' and doc_id%13=0 then 'abstain_correct' else 'abstain_miss' end
       when field='total_amount' and doc_id%13=0 then 'wrong' when field='lead' then case when length(trim(text))=0 then 'wrong' when {v}={lead} then 'correct' else 'wrong' end when wrong then 'wrong' else 'correct' end as outcome,
  field='lead' as cited, field='lead' and (contains({lead},{v}) or contains({v},{lead})) as verified,
  case when field='lead' then not contains({_norm('text')}, {v}) when blank then false else not contains({_norm('text')},
    case field when 'quality' then cast(case when wrong then 1-quality else quality end as varchar) when 'total_amount' then concat(cast(doc_id*37+1000+case when wrong then 1 else 0 end as varchar),' 元')
     else case when wrong then concat(cast(doc_id%28+1 as varchar),'/2/2024') when m=1 then concat(cast(doc_id%28+1 as varchar),'/1/2024') else concat(cast(doc_id%28+1 as varchar),' jan 2024') end end) end as absent from {name}_d)"""


@query("V1_value_match", f"with {out_sql()} select dataset, model, doc_id, field, outcome from o")
def _match(spark, sf):
    return outcomes(spark, sf).select("dataset", "model", "doc_id", "field", "outcome")


@query("V2_field_outcomes", f"with {out_sql()} select * from o")
def _outcomes(spark, sf):
    return outcomes(spark, sf)


query("V3_hpes", f"""with {out_sql()}, g as (select dataset, model, count(*) as n, count(*) filter (where outcome='correct') as c, count(*) filter (where outcome='wrong') as w, count(*) filter (where outcome like 'abstain%') as a, count(*) filter (where outcome='abstain_correct') as ac from o group by 1,2)
select dataset, model, n as n_fields, c as correct, w as wrong, a as abstained, ac as abstain_correct, round((c-2.0::double*w)/n,4) as hpes_raw, round(((c-2.0::double*w)/n+2)/3,4) as hpes_normalized, round(c/n,4) as naive_accuracy, 0.6667 as break_even from g""")(
    lambda spark, sf: V.hpes(outcomes(spark, sf)))
query("V4_cvr", f"""with {out_sql()}, g as (select dataset, model, count(*) filter (where outcome in ('correct','wrong')) as answered, count(*) filter (where cited) as cited, count(*) filter (where verified) as ok, count(*) filter (where absent) as absent from o group by 1,2)
select *, round(cited/greatest(answered,1),4) as citation_coverage, round(ok/greatest(cited,1),4) as verified_rate, round(absent/greatest(answered,1),4) as fabrication_rate from g""")(lambda spark, sf: V.cvr(outcomes(spark, sf)))


@query("V5_crc", f"""with {out_sql(0, 'a')}, {out_sql(1, 'b')} select b.dataset, b.model, count(*) as considered, count(*) filter (where b.outcome='correct') as followed, round(count(*) filter (where b.outcome='correct')/count(*),4) as robustness
from b join a on a.dataset=b.dataset and a.model=b.model and a.doc_id=b.doc_id and a.field=b.field and a.outcome='correct' where (b.doc_id+length(b.field))%2=0 group by 1,2""")
def _crc(spark, sf):
    changed = outcomes(spark, sf).where((F.col("doc_id") + F.length("field")) % 2 == 0).select("doc_id", "field").distinct()
    return V.crc(outcomes(spark, sf), outcomes(spark, sf, 1), changed)


CURVE_SQL = f"with {out_sql()}, cv as (select dataset, model, row_number() over w as i, count(*) over (partition by dataset, model) as n, sum(case when outcome='wrong' then 1 else 0 end) over (w rows unbounded preceding) as errors from o where outcome in ('correct','wrong') window w as (partition by dataset, model order by confidence desc, doc_id, field))"
query("V6_risk_coverage", CURVE_SQL + " select dataset, model, max(n) as n, round(avg(round(errors/i,4)),4) as aurc, round(coalesce(max(i/n) filter (where errors/i<=0.05),0),4) as coverage_at_target, round(max(errors)/max(n),4) as overall_risk from cv group by 1,2")(
    lambda spark, sf: V.risk_coverage(V.risk_curve(outcomes(spark, sf))))
query("V6_curve", CURVE_SQL + " select dataset, model, i, round(i/n,4) as coverage, round(errors/i,4) as risk from cv where (i-1)%greatest(1,n//40)=0")(
    lambda spark, sf: V.thin_curve(V.risk_curve(outcomes(spark, sf))))


def qa(spark, sf):
    """Questions and answers from the conversations: what is expected follows the turn, what was answered follows another turn."""
    a = X.asked(spark, sf)
    k = F.col("query_id")
    items = a.select(k.alias("id"), F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (k % 3 + 1).cast("int")).alias("tier"), "q", (k % 5 == 0).alias("must_abstain"),
                     F.when(k % 4 == 0, F.concat(F.lit("src"), (k % 8).cast("string"))).alias("expect_source"),
                     F.when(k % 3 == 0, F.array(F.lit("保證 成數"), F.lit("1,234"))).alias("expect_contains"), F.when(k % 2 == 0, F.lit("ageing")).alias("expect_route"))
    routes = Q.route(a).groupBy("query_id").agg(F.collect_set("metric").alias("routes"))
    ans = a.join(routes, "query_id", "left").select(k.alias("id"), F.col("q").alias("answer"), (k % 7 == 0).alias("abstained"), F.array(F.concat(F.lit("src"), (k % 12).cast("string"))).alias("sources"),
                                                    F.coalesce("routes", F.array().cast("array<string>")).alias("routes"), (k % 4).cast("int").alias("n_claims"), F.floor((k % 4) / 2).cast("int").alias("n_grounded"))
    return items, ans


QA_SQL = f"""with {X.ASKED_SQL}, r as (select query_id as id, (['easy','medium','hard'])[query_id%3+1] as tier, query_id%5=0 as must_abstain, query_id%7=0 as abstained, query_id as k, regexp_replace(q,'[\\s,]','','g') as a, q from asked),
s as (select *, not must_abstain and not abstained as live from r), t as (select *, case when live and k%4=0 then k%8=k%12 end as source_ok, case when live and k%3=0 then contains(a,'保證成數') or contains(a,'1234') end as facts_ok,
  case when live and k%2=0 then ({" or ".join(f"contains(regexp_replace(q,'\\s+','','g'),'{w}')" for w in Q.ROUTES['ageing'])}) and not ({" or ".join(f"contains(regexp_replace(q,'\\s+','','g'),'{w}')" for w in Q.THIRD_PARTIES)}) end as route_ok,
  case when live and k%4>0 then round((k%4//2)/(k%4),3) end as citation_rate from s),
scored as (select id, tier, must_abstain, abstained, not must_abstain and abstained as over_abstain, source_ok, facts_ok, route_ok, citation_rate, case when must_abstain then abstained when abstained then false else coalesce(source_ok,true) and coalesce(facts_ok,true) and coalesce(route_ok,true) end as passed from t)"""


def scored(spark, sf):
    return written(spark, sf, "qa_scored", lambda: V.score_answers(*qa(spark, sf)))


@query("V7_answer_scores", QA_SQL + " select id, tier, over_abstain, coalesce(cast(source_ok as int),-1) as source_ok, coalesce(cast(facts_ok as int),-1) as facts_ok, coalesce(cast(route_ok as int),-1) as route_ok, coalesce(citation_rate,-1) as citation_rate, passed from scored")
def _scores(spark, sf):
    n = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c)
    return scored(spark, sf).select("id", "tier", "over_abstain", n("source_ok"), n("facts_ok"), n("route_ok"), F.coalesce("citation_rate", F.lit(-1.0)).alias("citation_rate"), "passed")


query("V8_answer_summary", QA_SQL + """ select coalesce(tier,'all') as tier, count(*) as n, round(avg(passed::int),3) as pass_rate, count(*) filter (where must_abstain) as n_must_abstain, round(avg(passed::int) filter (where must_abstain),3) as abstain_rate,
 count(*) filter (where must_abstain and not passed) as hallucinated, count(*) filter (where over_abstain) as n_over_abstain, round(avg(over_abstain::int) filter (where not must_abstain),3) as over_abstain_rate, round(avg(source_ok::int),3) as source_rate,
 round(avg(facts_ok::int),3) as fact_rate, round(avg(route_ok::int),3) as route_rate, round(avg(citation_rate),3) as citation_rate from scored group by rollup(tier)""")(lambda spark, sf: V.summarise(scored(spark, sf)))


@query("V9_answer_key", """with l as (select doc_id, string_split(text, chr(10)) as l from documents),
i as (select d.doc_id as id, concat('doc-', cast(d.doc_id as varchar), case when d.doc_id%9=0 then 'x' else '' end) as source, d.l[len(d.l)] as q, d.doc_id%5=0 as must, d.doc_id%3=0 as hasf, array_to_string(f.l[greatest(1,len(f.l)-1):len(f.l)], chr(10)) as frag
  from l d left join l f on f.doc_id=d.doc_id+d.doc_id%2),
c as (select concat('doc-', cast(doc_id as varchar)) as source, regexp_replace(text,'[\\s,]','','g') as body from documents)
select id, 'missing source' as problem, source as detail from i where source not in (select source from c) union all
select id, 'fragment not in source', coalesce(frag,'') from i join c using(source) where hasf and not contains(body, regexp_replace(coalesce(frag,''),'[\\s,]','','g')) union all
select id, 'abstain with facts', '' from i where must and hasf union all
select id, 'repeated question', cast(n as varchar) from (select id, count(*) over (partition by regexp_replace(q,'[\\s,]','','g')) as n from i) z where n>1""")
def _key(spark, sf):
    """An item for each document: its last line asks, the last two lines of it or of the next one are expected, and lines are the chunks."""
    d = D.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    k = F.col("doc_id")
    last = F.array_join(F.slice("l", F.greatest(F.lit(1), F.size("l") - 1), 2), "\n")
    items = d.join(d.select(F.col("doc_id").alias("fd"), last.alias("frag")), F.col("fd") == k + k % 2, "left").select(
        k.alias("id"), F.element_at("l", -1).alias("q"), (k % 5 == 0).alias("must_abstain"), F.concat(F.lit("doc-"), k.cast("string"), F.when(k % 9 == 0, "x").otherwise("")).alias("expect_source"),
        F.when(k % 3 == 0, F.array(F.coalesce("frag", F.lit("")))).alias("expect_contains"))
    return V.validate_items(items, d.select(F.concat(F.lit("doc-"), k.cast("string")).alias("source"), F.posexplode("l").alias("seq", "text")))


query("V10_leakage", "select distinct trim(text) as q from documents where trim(text) in (select trim(text) from (select text from conversations union all select text from documents where doc_id%50=0) z)")(
    lambda spark, sf: V.leakage(D.table(spark, sf, "documents").select(F.col("text").alias("q")),
                                D.table(spark, sf, "conversations").select(F.col("text").alias("q")).union(D.table(spark, sf, "documents").where("doc_id % 50 = 0").select("text"))))

query("V11_threshold", """with r as (select quality=1 as answerable, cast(round(0.3+0.35*((doc_id*37)%1000)/1000.0 + case when quality=1 then 0.2 else 0 end,4) as double) as x from labels),
b as (select min(x) filter (where answerable) as lo, max(x) filter (where not answerable) as hi from r),
g as (select max(lo) as lo, max(hi) as hi, count(*) filter (where answerable) as ny, count(*) filter (where not answerable) as nn, avg(x) filter (where answerable) as my, avg(x) filter (where not answerable) as mn, stddev_samp(x) filter (where answerable) as sy, stddev_samp(x) filter (where not answerable) as sn,
 count(*) filter (where (answerable and x<=hi) or (not answerable and x>=lo)) as ov, count(*) filter (where not answerable and x<round(lo-0.03,4)) as caught, count(*) filter (where answerable and x<round(lo-0.03,4)) as fp from r cross join b)
select round(lo-0.03,4) as threshold, lo>hi as separable, round(ov/(ny+nn),3) as overlap_rate, round((my-mn)/sqrt(((ny-1)*sy*sy+(nn-1)*sn*sn)/(ny+nn-2)),3) as cohens_d, caught, fp as false_pos, round(caught/nn,3) as catch_rate, round(fp/ny,3) as false_positive_rate from g""")(
    lambda spark, sf: V.threshold(D.table(spark, sf, "labels").select((F.col("quality") == 1).alias("answerable"), F.round(
        (F.lit("0.3").cast("decimal(10,6)") + F.lit("0.35").cast("decimal(10,6)") * ((F.col("doc_id") * 37) % 1000).cast("decimal(10,0)") / F.lit(1000).cast("decimal(10,0)") + F.when(F.col("quality") == 1, F.lit("0.2")).otherwise(F.lit("0")).cast("decimal(10,6)")), 4).cast("double").alias("top_dense"))))

# ---- detection: each case is a trial; the check it is expected to fail follows its number -----------------------------------
EXPECT = ["TAXID-01", "ARITH-01", "FRAUD-01", "DUP-01", "TERM-02", "TERM-03", "DATE-01", None]
_EXP_SQL = "[" + ",".join(f"'{e}'" if e else "null" for e in EXPECT) + "]"
_FOUND = "select tenant_id as trial, check_id, passed from (" + FOUND_SQL[len("found as ("):-1] + ") q_all"
DETECT_SQL = with_tables("inv", extra=f"""f as ({_FOUND}), lab as (select distinct tenant_id as trial, concat('D0', cast(cast(substr(tenant_id,6) as bigint)%8 as varchar)) as defect_id, ({_EXP_SQL})[cast(substr(tenant_id,6) as bigint)%8+1] as expected_check from inv),
base as (select check_id, bool_and(passed) as passed from f where trial='CASE-0001' group by 1), clean as (select check_id from base where not passed), nc as (select count(*) as n_checks, count(*) filter (where not passed) as n_cf from base),
fail as (select distinct trial, check_id from f where not passed), ex as (select * from fail where check_id not in (select check_id from clean)),
m as (select defect_id, max(expected_check) as expected_check, count(*) as trials, sum(case when exists (select 1 from fail x where x.trial=lab.trial and x.check_id=expected_check) then 1 else 0 end) as hits,
  sum((select count(*) from ex where ex.trial=lab.trial and ex.check_id is distinct from expected_check)) as fp, sum((select n_checks-n_cf from nc) - (select count(*) from ex where ex.trial=lab.trial)) as tn from lab group by 1)""")

def _detected(spark, sf):
    inv, con, led = D.invoices(spark, sf), D.contracts(spark, sf), D.ledger(spark, sf)
    return written(spark, sf, "detect_findings", lambda: C.findings(inv, con, led, D.AS_OF, C.VERDICTS).select(F.col("tenant_id").alias("trial"), "check_id", "passed"))


def _matrix(spark, sf):
    inv, f = D.invoices(spark, sf), _detected(spark, sf)
    n = (F.substring("tenant_id", 6, 20).cast("bigint") % 8).cast("int")
    lab = inv.select("tenant_id").distinct().select(F.col("tenant_id").alias("trial"), F.concat(F.lit("D0"), n.cast("string")).alias("defect_id"),
                                                    F.element_at(F.array(*[F.lit(e).cast("string") for e in EXPECT]), n + 1).alias("expected_check"))
    return V.detection_matrix(f, lab, f.where("trial = 'CASE-0001'"))


_MATRIX_SQL = " select defect_id, coalesce(expected_check,'') as expected_check, trials, cast(hits as bigint) as hits, cast(fp as bigint) as fp, cast(tn as bigint) as tn, round(hits/trials,4) as detection_rate from m"


def _detect(spark, sf):
    return _matrix(spark, sf).withColumn("expected_check", F.coalesce("expected_check", F.lit("")))


query("V12_detection_matrix", DETECT_SQL + _MATRIX_SQL)(lambda spark, sf: _detect(spark, sf))


_RATES = ["precision", "recall", "specificity", "accuracy", "f1", "mcc"]


_TOTALS_SQL = """, t as (select cast(sum(case when expected_check is not null then hits else 0 end) as double) as tp, cast(sum(fp) as double) as fp, cast(sum(tn) as double) as tn, cast(sum(case when expected_check is not null then trials-hits else 0 end) as double) as f1, cast(sum(case when expected_check is null then trials else 0 end) as double) as f2 from m),
s as (select 'detectable' as scope, tp, fp, tn, f1 as fn from t union all select 'all', tp, fp, tn, f1+f2 from t)
select scope, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(tn as bigint) as tn, cast(fn as bigint) as fn, round(tp/nullif(tp+fp,0),6) as precision, round(tp/nullif(tp+fn,0),6) as recall, round(tn/nullif(tn+fp,0),6) as specificity, round((tp+tn)/(tp+tn+fp+fn),6) as accuracy,
 round(2*(tp/nullif(tp+fp,0))*(tp/nullif(tp+fn,0))/((tp/nullif(tp+fp,0))+(tp/nullif(tp+fn,0))),6) as f1, round((tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)),6) as mcc, 20*fn+fp as cost, round(1-(20*fn+fp)/(20*(tp+fn)),4) as cost_normalized from s"""


def _totals(spark, sf):
    d = V.detection_totals(_matrix(spark, sf))
    return d.select("scope", *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "tn", "fn")], *[F.round(c, 6).alias(c) for c in _RATES], "cost", "cost_normalized")


query("V12_detection_totals", DETECT_SQL + _TOTALS_SQL)(lambda spark, sf: _totals(spark, sf))


_KEY_SQL = """, e as (select distinct trial, expected_check as check_id from lab where expected_check is not null)
select trial, check_id, 'missed' as kind from e where not exists (select 1 from fail where fail.trial=e.trial and fail.check_id=e.check_id) union all select trial, check_id, 'extra' from fail where not exists (select 1 from e where fail.trial=e.trial and fail.check_id=e.check_id)"""


def _reconcile(spark, sf):
    inv, f = D.invoices(spark, sf), _detected(spark, sf)
    n = (F.substring("tenant_id", 6, 20).cast("bigint") % 8).cast("int")
    e = inv.select("tenant_id").distinct().select(F.col("tenant_id").alias("trial"), F.element_at(F.array(*[F.lit(x).cast("string") for x in EXPECT]), n + 1).alias("check_id")).where("check_id is not null")
    return V.reconcile_key(f.where("not passed"), e, ["trial", "check_id"])


query("V13_key_reconciliation", DETECT_SQL + _KEY_SQL)(lambda spark, sf: _reconcile(spark, sf))


def runs(spark, sf):
    """Each user's events as repeated outputs: same structure, values by event, some with a key more or other spacing."""
    e = D.table(spark, sf, "events")
    raw = F.when(F.col("user_id") % 4 == 0, F.lit('{"k": 1}')).when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"k":  1, "t": "'), "event_type", F.lit('"}'))).otherwise(F.col("props"))
    return e.select(F.col("user_id").alias("label"), F.col("event_id").alias("run"), raw.alias("raw"), F.col("value").alias("latency"))


@query("V14_output_drift", """with r as (select user_id as label, event_id as run, value as latency, case when user_id%4=0 then '{"k": 1}' when event_id%5=0 then concat('{"k":  1, "t": "', event_type, '"}') else props end as raw from events),
p as (select *, array_to_string(list_sort(json_keys(raw)),',') as s, concat(cast(json_extract(raw,'$.k') as varchar), '|', coalesce(json_extract_string(raw,'$.t'),'')) as m from r),
f as (select label, min_by(raw, run) as fr, min_by(s, run) as fs, min_by(m, run) as fm from p group by 1)
select p.label, count(*) as runs, count(*) filter (where raw=fr) as bitwise, count(*) filter (where s=fs) as structural, count(*) filter (where m=fm) as semantic, count(distinct raw) as distinct_outputs, quantile_cont(latency,0.5) as median_latency,
 case when count(*) filter (where raw=fr)/count(*)>=0.99 then 1 when count(*) filter (where s=fs)/count(*)>=0.95 then 2 else 3 end as tier from p join f on f.label=p.label group by 1""")
def _drift(spark, sf):
    return V.drift(runs(spark, sf))


query("V15_reproducibility", "select event_type as condition, count(*) as runs, count(distinct user_id%4) as n_confidence, count(distinct user_id%2) as n_citation, count(distinct props) as n_claims_text, count(distinct user_id%4)=1 and count(distinct props)=1 as stable from events group by 1")(
    lambda spark, sf: V.reproducibility(D.table(spark, sf, "events").select(F.col("event_type").alias("condition"), (F.col("user_id") % 4).alias("confidence"), (F.col("user_id") % 2).alias("citation"), F.col("props").alias("claims_text"))))

from .case_checks import ban_ok_sql  # noqa: E402

query("V16_award_quality", f"""with a as (select o_orderkey%5000 as number, cast(20000000+(o_custkey*104729)%79999999 as varchar) as seller_ban, o_orderpriority as buyer_name, case when o_orderkey%10=0 then null else cast(o_totalprice as decimal(18,2)) end as amount, o_orderkey as seq from orders),
u as (select * from (select *, row_number() over (partition by number, seller_ban order by seq) as rn from a) z where rn=1), v as (select amount, row_number() over (order by amount)-1 as rn, count(*) over () as n from u where amount is not null)
select count(*) as records, count(distinct seller_ban) as sellers, count(distinct buyer_name) as buyers, count(*) filter (where {ban_ok_sql('seller_ban')}) as valid_ids, count(amount) as with_amount, cast(min(amount) as double) as min_amount, cast(max(amount) as double) as max_amount, cast(sum(amount) as double) as sum_amount,
 (select cast(amount as double) from v where rn=n//2) as median_amount, round(count(*) filter (where {ban_ok_sql('seller_ban')})/count(*),4) as valid_rate, round(count(amount)/count(*),4) as amount_coverage from u""")(
    lambda spark, sf: V.award_quality(D.table(spark, sf, "orders").select((F.col("o_orderkey") % 5000).alias("number"), (F.lit(20000000) + (F.col("o_custkey") * 104729) % 79999999).cast("string").alias("seller_ban"),
        F.col("o_orderpriority").alias("buyer_name"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"), F.col("o_orderkey").alias("seq"))))

_LOAN = "case when o_orderstatus='F' then 'PIF' when o_orderstatus='O' and o_custkey%3=0 then 'CHGOFF' when o_custkey%3=1 then 'EXEMPT' end"


def _loans(spark, sf):
    s, c = F.col("o_orderstatus"), F.col("o_custkey") % 3
    return D.table(spark, sf, "orders").select(F.when(s == "F", "PIF").when((s == "O") & (c == 0), "CHGOFF").when(c == 1, "EXEMPT").alias("LoanStatus"))


query("V17_loan_status", f"select coalesce({_LOAN},'?') as status, count(*) as n from orders group by 1")(lambda spark, sf: V.loan_status(_loans(spark, sf))[0])
query("V17_default_rate", f"with l as (select {_LOAN} as s from orders) select count(*) filter (where s='CHGOFF') as charged_off, count(*) filter (where s='PIF') as paid_in_full, round(count(*) filter (where s='CHGOFF')/count(*) filter (where s in ('CHGOFF','PIF')),4) as default_rate from l")(
    lambda spark, sf: V.loan_status(_loans(spark, sf))[1])


def bio_documents(spark, sf):
    """Words of every document, tagged by a hash of their position."""
    d = D.table(spark, sf, "documents").where("text is not null").select("doc_id", F.split("text", r"\s+").alias("words"))

    def tag(pos):
        n = F.pmod(F.xxhash64("doc_id", F.floor(pos / 2)), F.lit(9))
        mark = F.when(F.pmod(F.xxhash64(pos, "doc_id"), F.lit(3)) == 0, "B-").otherwise("I-")
        return F.when(n <= 3, F.concat(mark, F.lit("QUESTION"))).when(n <= 6, F.concat(mark, F.lit("ANSWER"))).otherwise("O")

    return d.select("doc_id", "words", F.transform(F.sequence(F.lit(0), F.size("words") - 1), tag).alias("tags"))


query("V18_bio_pairs")(lambda spark, sf: V.bio_document_pairs(bio_documents(spark, sf)))


@query("V19_json_leaves", "select event_id as doc_id, concat(event_type, ' ', props, ' ', cast(user_id as varchar), ' receipt text') as text from events where length(concat(event_type, ' ', props, ' ', cast(user_id as varchar), ' receipt text'))>=30")
def _leaves(spark, sf):
    e = D.table(spark, sf, "events")
    raw = F.to_json(F.struct(F.col("event_type").alias("a"), F.struct("props", F.col("value").alias("n")).alias("b"), F.array(F.col("user_id").cast("string"), F.lit("receipt text")).alias("c")))
    return V.leaf_texts(e.select(F.col("event_id").alias("doc_id"), raw.alias("raw")))
