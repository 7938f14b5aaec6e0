"""Registered queries for citation checks, corroboration, confidence and text audits (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.joins import broadcast_if_small
from ..functions.text import match_norm
from ..operators import evidence as E, retrieval as R
from ..session import written
from ..sources.driver_tables import table
from . import texts as X
from .registry import query
from .retrieval_queries import all_sql


def retrieved(spark, sf):
    return written(spark, sf, "retrieved", lambda: R.hybrid(X.chunk_texts(spark, sf), X.questions(spark, sf), **X.indexes(spark, sf)))


def context(spark, sf):
    """Texts retrieved per answer, led by a phrase that states figures; a source names itself in its text. Stored once per application, found by
    one pass over the texts where the retrieved ones are few."""
    def make():
        r = retrieved(spark, sf)
        t = X.chunk_texts(spark, sf).select("chunk_id", "text")
        said = F.element_at(F.array(F.lit("保證成數九成。"), F.lit("保證成數為 90%，日本 日本 日本。"), F.lit("付款條件 60 天，中國信託商業銀行。"), F.lit("台灣的保證成數百分之八十。")), (F.col("chunk_id") % 4 + 1).cast("int"))
        return t.join(broadcast_if_small(r), "chunk_id").select(F.col("query_id").alias("answer_id"), "chunk_id", "source", F.col("place").alias("rank"), F.concat(said, "text").alias("text"))

    return written(spark, sf, "context", make)


CTX_SQL = all_sql() + """, ctx as (select query_id as answer_id, chunk_id, source, place as rank, concat((['保證成數九成。','保證成數為 90%，日本 日本 日本。','付款條件 60 天，中國信託商業銀行。','台灣的保證成數百分之八十。'])[chunk_id%4+1], text) as text
  from ret join (select chunk_id, text from chunks) c using(chunk_id) where place<=8)"""


def answers(spark, sf):
    b = table(spark, sf, "benchmark")
    k = F.col("item_id")
    said = F.element_at(F.array(F.lit("成數九成，中國信記商業銀行"), F.lit("付款條件 60 天"), F.lit("成數 80%，金額 12,000,000 元"), F.lit("玉山商業銀行 無數字"), F.lit("成數五成，中國信託商業銀行")), (k % 5 + 1).cast("int"))
    return b.select(k.alias("answer_id"), F.format_string("CASE-%04d", (k % 100).cast("bigint")).alias("tenant_id"),
                    F.concat_ws(" ", X.phrase(k), "text").alias("question"), F.concat(said, F.lit("\n\n\n\n"), "text").alias("answer"), F.col("text").alias("item_text"))


ANS_SQL = f"""answers as (select item_id as answer_id, concat({X.phrase_sql('item_id')}, ' ', text) as question,
  concat((['成數九成，中國信記商業銀行','付款條件 60 天','成數 80%，金額 12,000,000 元','玉山商業銀行 無數字','成數五成，中國信託商業銀行'])[item_id%5+1], chr(10)||chr(10)||chr(10)||chr(10), text) as answer, text as item_text from benchmark)"""


def claims(spark, sf):
    """Six claims per answer: whole passage, shortened in order, shortened in the wrong order, too short, one word
    changed, and a passage of another answer; sources are written with blanks and capitals, or wrongly."""
    a = answers(spark, sf)
    first = retrieved(spark, sf).where("place = 1").select(F.col("query_id").alias("answer_id"), F.col("source").alias("top"))
    a = a.join(first, "answer_id", "left")
    t, n = F.col("item_text"), F.length("item_text")
    head, tail = F.substring(t, 1, 40), F.right(t, F.lit(40))
    mk = lambda no, q, src: F.struct(F.lit(no).alias("claim_no"), q.alias("quote"), src.alias("source"))
    loud = F.concat(F.lit(" "), F.upper("top"))
    c = F.array(mk(1, t, loud), mk(2, F.concat(head, F.lit("…"), tail), F.col("top")), mk(3, F.concat(tail, F.lit("…"), head), F.col("top")),
                mk(4, F.lit("the of"), F.col("top")), mk(5, F.concat(F.substring(t, 1, 50), F.lit("x"), F.substring(t, 52, 1 << 30)), loud), mk(6, t, F.lit("no such source at all")))
    return a.select("answer_id", F.explode(c).alias("c"), "item_text").select("answer_id", "c.claim_no", F.when(F.col("c.claim_no") == 6, F.col("item_text")).otherwise(F.col("c.quote")).alias("statement"), "c.quote", "c.source")


def verified(spark, sf):
    return written(spark, sf, "verified", lambda: E.verify_claims(claims(spark, sf), context(spark, sf)))


@query("E1_match_norm", "select doc_id, md5(lower(translate(regexp_replace(nfc_normalize(text), '\\s+', '', 'g'), '，。、；：？！「」『』（）()[]【】-—–_·．.,:;!?\"''`*#>', ''))) as h from documents")
def _norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(match_norm(F.col("text"))).alias("h"))


@query("E2_source_names", CTX_SQL + """, top as (select answer_id, source as top from ctx where rank=1), n as (select item_id as answer_id, unnest([1,2,3,4,5,6]) as claim_no from benchmark)
select n.answer_id, claim_no, case claim_no when 1 then concat(' ', upper(top)) when 5 then concat(' ', upper(top)) when 6 then 'no such source at all' else top end as source, case when claim_no=6 then '' else top end as resolved
from n join top on top.answer_id=n.answer_id""")
def _sources(spark, sf):
    return E.resolve_sources(claims(spark, sf), context(spark, sf)).select("answer_id", "claim_no", "source", F.coalesce("resolved", F.lit("")).alias("resolved"))


@query("E3_citation_verdict")
def _verdicts(spark, sf):
    return verified(spark, sf).select("answer_id", "claim_no", "verdict", "grounded", F.coalesce("matched_source", F.lit("")).alias("matched_source"), F.round("match_score", 4).alias("match_score"))


@query("E4_citation_integrity")
def _integrity(spark, sf):
    return E.integrity(answers(spark, sf), verified(spark, sf)).withColumn("citation_integrity", F.round("citation_integrity", 6))


@query("E6_corroboration", CTX_SQL + f""", {ANS_SQL}, said as (select answer_id, kind, value from (select answer_id, unnest([
   case when answer_id%5=0 then ['guarantee_ratio','0.900000'] when answer_id%5=1 then ['payment_terms','60'] when answer_id%5=2 then ['guarantee_ratio','0.800000'] when answer_id%5=4 then ['guarantee_ratio','0.500000'] end]) as p from answers) z, lateral (select p[1] as kind, p[2] as value) y where p is not null),
src as (select distinct answer_id, source, case when chunk_id%4=2 then 'payment_terms' else 'guarantee_ratio' end as kind, (['0.900000','0.900000','60','0.800000'])[chunk_id%4+1] as value from ctx),
per as (select s.answer_id, s.kind, s.value, r.source, bool_or(r.value=s.value) as same from said s left join src r on r.answer_id=s.answer_id and r.kind=s.kind group by 1,2,3,4),
g as (select answer_id, kind, value, count(*) filter (where same) as agree, count(*) filter (where not same) as conflict from per group by 1,2,3)
select answer_id, kind, value, agree, conflict, round(least(1.0::double, agree/3.0::double) * case when agree+conflict>0 then agree::double/(agree+conflict) else 0 end, 6) as score from g""")
def _corroboration(spark, sf):
    return E.corroboration(answers(spark, sf), context(spark, sf)).select("answer_id", "kind", "value", "agree", "conflict", F.round("score", 6).alias("score"))


@query("E7_missing_scope")
def _missing(spark, sf):
    return E.missing_scope(answers(spark, sf), context(spark, sf))


def _count_sql(ws) -> str:
    return "+".join(f"((length(text)-length(replace(text,'{w}','')))//{len(w)})" for w in ws)


def _conflict_sql() -> str:
    js = list(E.JURIS_WORDS.items())
    asked = "list_filter([" + ",".join("case when " + " or ".join(f"contains(question,'{w}')" for w in ws) + f" then '{j}' end" for j, ws in js) + "], lambda x: x is not null)"
    hits = "[" + ",".join(f"{{'j': '{j}', 'n': {_count_sql(ws)}}}" for j, ws in js) + "]"
    return CTX_SQL + f""", {ANS_SQL}, a as (select answer_id, {asked} as asked from answers), h as (select answer_id, chunk_id, asked, {hits} as hits from ctx join a using(answer_id) where len(asked)>0),
o as (select answer_id, chunk_id, list_sum(list_transform(list_filter(hits, lambda x: list_contains(asked, x.j)), lambda x: x.n)) as own, list_filter(hits, lambda x: not list_contains(asked, x.j) and x.n>=2) as other from h)
select answer_id, chunk_id, other[1].j as jurisdiction, other[1].n as mentions from o where own=0 and len(other)>0"""


@query("E8_jurisdiction_conflict", _conflict_sql())
def _conflicts(spark, sf):
    c = context(spark, sf)
    return E.jurisdiction_conflicts(answers(spark, sf), c).join(c.select("answer_id", "rank", "chunk_id"), ["answer_id", "rank"]).select("answer_id", "chunk_id", "jurisdiction", "mentions")


def parts(spark, sf):
    a, c, v = answers(spark, sf), context(spark, sf), verified(spark, sf)
    stripped = E.strip_ungrounded(a, v)
    return stripped, E.confidence(stripped, v, c, R.health(retrieved(spark, sf)), E.missing_scope(a, c))


@query("E9_confidence")
def _confidence(spark, sf):
    d = parts(spark, sf)[1]
    return d.select("answer_id", "confidence", *[F.round(c, 6).alias(c) for c in ("citation_integrity", "strength", "corroboration", "sparse_health")], "dense_gated", "scope_gated")


@query("E9_confidence_unstripped")
def _confidence_raw(spark, sf):
    return E.confidence_raw(verified(spark, sf), parts(spark, sf)[1]).select("answer_id", "confidence")


@query("E10_gates")
def _gates(spark, sf):
    a, p = parts(spark, sf)
    return E.gates(p, a)


@query("E11_strip_ungrounded")
def _strip(spark, sf):
    return E.strip_ungrounded(answers(spark, sf), verified(spark, sf)).select("answer_id", "answer", "n_removed")


@query("E12_name_typos", CTX_SQL + f""", {ANS_SQL} select answer_id, '中國信記商業銀行' as written, '中國信託商業銀行' as likely, 87.5 as similarity from answers a where answer_id%5=0 and exists (select 1 from ctx c where c.answer_id=a.answer_id and chunk_id%4=2)""")
def _typos(spark, sf):
    return E.name_typos(answers(spark, sf), context(spark, sf))


def marked(spark, sf):
    """Texts with marks: the last line of the document, the same with another ending as a list item, figures, and bare lines."""
    d = table(spark, sf, "documents")
    frag = F.regexp_replace(F.element_at(F.split("text", "\n"), -1), "[「」]", " ")
    lines = F.array(F.lit("# 標題"), F.concat(F.lit("📗 原文 「"), frag, F.lit("」")), F.concat(F.lit("- 續列 「"), frag, F.lit(" zzz」")), F.lit(""), F.lit("段落無標記 12,345 元"),
                    F.concat(F.lit("📊 金額 "), (F.lit(10000) + F.col("doc_id")).cast("string"), F.lit(" 元 統計金額")), F.lit("## 結尾"), F.lit("| 表格 | 88% |"))
    return d.select("doc_id", F.array_join(lines, "\n").alias("text"))


def figures(spark, sf):
    """The corpus: the documents, each third with its figure stated next to the word."""
    d = table(spark, sf, "documents")
    return d.select(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("統計金額 "), (F.lit(10000) + F.col("doc_id")).cast("string"), F.lit(".00 元"))).otherwise(F.col("text")).alias("body"))


@query("E14_text_audit", """with d as (select doc_id, regexp_replace(list_last(string_split(text, chr(10))), '[「」]', ' ', 'g') as frag from documents),
b as (select distinct case when doc_id%3=0 then concat(text, '統計金額 ', cast(10000+doc_id as varchar), '.00 元') else text end as body from documents),
s as (select regexp_replace(body, '\\s+', '', 'g') as b from b), w as (select replace(body, ',', '') as n from b where contains(body, '統計金額')), p as (select n, position('統計金額' in n) as p from w),
q as (select doc_id, 2 as line_no, frag as value from d union all select doc_id, 3, concat(frag, ' zzz') from d),
n as (select doc_id, q.line_no, value, regexp_replace(value, '\\s+', '', 'g') as norm from q where length(value) >= 6),
k as (select distinct norm, exists (select 1 from s where contains(b, norm)) as ok from n where length(norm) >= 6),
m as (select doc_id, cast(10000+doc_id as varchar) as value from documents)
select doc_id, line_no, 'quote' as kind, value, ok as verified from n join k using (norm) union all
select doc_id, 6, 'number', value, exists (select 1 from p, (select 4 as lw, 0 as o union all select 2, 2) z where contains(substr(n, greatest(1, p+o-(200-lw)), least(p+o-1, 200-lw)), value) or contains(substr(n, p+o+lw, 200-lw+length(value)), value)) from m union all
select doc_id, 5, 'unmarked', '段落無標記 12,345 元', false from d union all select doc_id, 8, 'unmarked', '| 表格 | 88% |', false from d""")
def _audit(spark, sf):
    return E.audit_marked(marked(spark, sf), figures(spark, sf), "doc_id")


@query("E15_quote_pairs", """with l as (select doc_id, source, unnest(string_split(regexp_replace(text, '[「」]', ' ', 'g'), chr(10))) as q, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
k as (select *, row_number() over (partition by doc_id, substr(trim(q), 1, 80) order by i) as r from l where length(q) between 6 and 257)
select doc_id, trim(q) as quote, source from k where r=1""")
def _pairs(spark, sf):
    """Every line of every text as a quotation with its source; quotations that begin before the look-back have none."""
    d = table(spark, sf, "documents")
    lines = F.filter(F.split(F.regexp_replace("text", "[「」]", " "), "\n"), lambda q: F.length(q) >= 6)
    tag = F.concat(F.lit("」 [來源: "), "source", F.lit("]"))
    t = F.array_join(F.transform(lines, lambda q: F.concat(F.lit("「"), q, tag)), " ")
    return E.paired_quotes(d.select("doc_id", "source", t.alias("text")), "doc_id").select("doc_id", "quote", "source")


@query("E16_failure_layers")
def _layers(spark, sf):
    return E.failure_layers(claims(spark, sf), context(spark, sf)).withColumn("share", F.round("share", 6))


@query("E16_layer_tally")
def _tally(spark, sf):
    return E.failure_layers(claims(spark, sf), context(spark, sf)).groupBy("layer").agg(F.count("*").alias("n"))
