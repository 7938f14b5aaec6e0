"""Registered queries for the graph and the statistics (R, N, I5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G, questions as Q, statistics as S
from ..session import written
from ..sources import driver_tables as D
from . import texts as X
from .adapters_sql import with_tables
from .registry import query

NID = lambda kind, key: f"concat('{kind}:', substr(sha1(concat('{kind}|', {key})),1,16))"
EDGE_SQL = f"""raw as (select {NID('company', 'seller_ban')} as src_id, {NID('company', 'buyer_ban')} as dst_id, 'issued_to' as edge_type, tenant_id, total_amount as weight from inv
  union all select {NID('company', 'supplier_ban')}, {NID('company', 'buyer_ban')}, 'issued_to', tenant_id, amount from bil),
edges as (select src_id, dst_id, edge_type, tenant_id, sum(weight) as weight, count(*) as n_docs from raw group by 1,2,3,4)"""


def edges(spark, sf):
    return written(spark, sf, "trade_edges", lambda: G.merged_trade_edges(D.invoices(spark, sf), D.bills(spark, sf)))


query("R1_node_ids", f"select s_suppkey, {NID('supplier', 's_name')} as node_id from supplier")(
    lambda spark, sf: D.table(spark, sf, "supplier").select("s_suppkey", G.node_id("supplier", F.col("s_name")).alias("node_id")))

query("R2_company_nodes", with_tables("inv", "bil", extra="""n as (select tenant_id, seller_ban as ban, null as name, 0 as r, seq from inv union all select tenant_id, buyer_ban, buyer_name, 1, seq from inv
  union all select tenant_id, buyer_ban, null, 2, seq from bil union all select tenant_id, supplier_ban, supplier_name, 3, seq from bil)""") + f"""
select {NID('company', 'ban')} as node_id, 'company' as node_type, coalesce(name, ban) as label, tenant_id from (select *, row_number() over (partition by tenant_id, ban order by r>=2 desc, seq desc, r desc) as rn from n where name is not null or true) z where rn=1""")(
    lambda spark, sf: G.company_nodes(D.invoices(spark, sf), D.bills(spark, sf)))

query("R3_edge_merge", with_tables("inv", "bil", extra=EDGE_SQL) + "select src_id, dst_id, edge_type, tenant_id, cast(weight as double) as weight, n_docs from edges")(edges)


def scope_docs(spark, sf):
    d = D.table(spark, sf, "documents")
    k = F.col("doc_id")
    pubs = F.array(*[F.lit(p) for p in list(Q.PUBLISHER_JURISDICTION)] + [F.lit("other press")])
    lead = F.element_at(F.array(F.lit("日本與韓國與美國。"), F.lit("信用保證與送保。日本。"), F.lit("台灣 本國 供應商融資。")), (k % 3 + 1).cast("int"))
    return d.select(F.concat(F.lit("doc-"), k.cast("string")).alias("source"), F.element_at(pubs, (k % 10 + 1).cast("int")).alias("publisher"),
                    F.when(k % 4 > 0, F.concat((2020 + k % 4).cast("string"), F.lit("-0"), (1 + k % 9).cast("string"))).alias("published"),
                    F.when(k % 13 == 0, F.concat(F.lit("doc-"), (k + 1).cast("string"))).alias("superseded_by"), F.concat(F.repeat(lead, (k % 4 + 1).cast("int")), "text").alias("text"))


def doc_edges(spark, sf):
    return written(spark, sf, "document_edges", lambda: G.document_edges(scope_docs(spark, sf)))


def _n(ws):
    return "+".join(f"((length(t)-length(replace(t,'{w}','')))//{len(w)})" for w in ws)


_PUBS = "[" + ",".join(f"'{p}'" for p in list(Q.PUBLISHER_JURISDICTION) + ["other press"]) + "]"
_HOME = "case pub " + " ".join(f"when '{p}' then '{j}'" for p, j in Q.PUBLISHER_JURISDICTION.items()) + " end"
_M = " union all ".join(f"select source, 'jurisdiction' as dst_type, '{j}' as dst_label, 'mentions' as edge_type, {_n(ws)} as weight from h where home is distinct from '{j}' and {_n(ws)}>=3" for j, ws in Q.JURISDICTIONS.items())
_T = " union all ".join(f"select source, 'topic', '{t}', 'applies_to', {_n(ws)} from h where {_n(ws)}>=2" for t, ws in Q.TOPICS.items())
DOC_EDGE_SQL = f"""d as (select doc_id as k, concat('doc-', cast(doc_id as varchar)) as source, ({_PUBS})[doc_id%10+1] as pub, case when doc_id%4>0 then concat(cast(2020+doc_id%4 as varchar),'-0',cast(1+doc_id%9 as varchar)) end as published,
  case when doc_id%13=0 then concat('doc-', cast(doc_id+1 as varchar)) end as sup, concat('doc-', cast(doc_id as varchar), ' ', repeat((['日本與韓國與美國。','信用保證與送保。日本。','台灣 本國 供應商融資。'])[doc_id%3+1], doc_id%4+1), text) as t from documents),
h as (select *, {_HOME} as home from d),
dedge as (select {NID('document', 'source')} as src_id, dst_type, dst_label, edge_type, cast(weight as double) as weight from (
  select source, 'jurisdiction' as dst_type, home as dst_label, 'applies_to' as edge_type, 1 as weight from h where home is not null union all {_M} union all {_T}
  union all select source, 'period', published, 'applies_to', 1 from h where published is not null) z
  union all select {NID('document', 'sup')}, 'document', source, 'supersedes', 1 from h where sup is not null)"""


@query("R4_document_edges", f"with {DOC_EDGE_SQL} select * from dedge")
def _doc_edges(spark, sf):
    return doc_edges(spark, sf).select("src_id", "dst_type", "dst_label", "edge_type", "weight")


@query("R6_neighbours", with_tables("inv", "bil", extra=EDGE_SQL + f""",
u as (select distinct src_id as a, dst_id as b from edges where src_id<>dst_id union select distinct dst_id, src_id from edges where src_id<>dst_id),
st as (select distinct {NID('company', 'cast(20000000+(s_suppkey*7919)%79999999 as varchar)')} as start from supplier),
h1 as (select start, b as node_id, [start, b] as path from st join u on a=start),
h2 as (select start, b as node_id, list_concat(min(path), [b]) as path from h1 join u on a=node_id where b<>start and not exists (select 1 from h1 x where x.start=h1.start and x.node_id=b) group by 1, 2)""") + """
select start, node_id, 1 as hops, array_to_string(path,',') as path from h1 union all select start, node_id, 2, array_to_string(path,',') from h2""")
def _neighbours(spark, sf):
    s = D.table(spark, sf, "supplier").select(G.node_id("company", (F.lit(20000000) + (F.col("s_suppkey") * 7919) % 79999999).cast("string")).alias("node_id"))
    return G.neighbours(edges(spark, sf), s, 2).select("start", "node_id", "hops", "path")


query("R7_circular_trades", with_tables("inv", "bil", extra=EDGE_SQL + ", e as (select src_id, dst_id, sum(weight) as w from edges group by 1,2)") + """
select a.src_id as company_a, a.dst_id as company_b, cast(a.w as double) as a_to_b, cast(b.w as double) as b_to_a from e a join e b on a.src_id=b.dst_id and a.dst_id=b.src_id where a.src_id<a.dst_id""")(
    lambda spark, sf: G.circular_trades(edges(spark, sf)))


def rep_edges(spark, sf):
    c = D.table(spark, sf, "customer")
    person = F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string"), F.floor(F.abs("c_acctbal") / 1000).cast("string"))
    e = c.select(F.col("c_name").alias("src_id"), person.alias("dst_id"), F.lit("represented_by").alias("edge_type"))
    return e.union(e.where("length(src_id) % 2 = 0"))  # some edges are stated twice


query("R8_shared_representatives", """with e as (select distinct c_name as company, concat_ws(' ', c_mktsegment, cast(c_nationkey as varchar), cast(cast(floor(abs(c_acctbal)/1000) as bigint) as varchar)) as person from customer)
select person, company, company_count from (select *, count(*) over (partition by person) as company_count from e) z where company_count>1""")(
    lambda spark, sf: G.shared_representatives(rep_edges(spark, sf)))

_ASK = " union all ".join(f"select query_id, '{k}' as kind, '{n}' as label from asked where " + " or ".join(f"contains(q,'{w}')" for w in ws) for k, tb in (("jurisdiction", Q.JURISDICTIONS), ("topic", Q.TOPICS)) for n, ws in tb.items())
SCOPE_SQL = f"""with {X.ASKED_SQL}, {DOC_EDGE_SQL}, ask as ({_ASK}),
per as (select dst_type, dst_label, count(*) filter (where edge_type='applies_to') as n_applies, count(*) filter (where edge_type='mentions') as n_mentions from dedge group by 1,2),
top as (select dst_type, dst_label, string_agg(src_id, ',' order by weight desc, src_id) as mentioned_in from (select *, row_number() over (partition by dst_type, dst_label order by weight desc, src_id) as rn from dedge where edge_type='mentions') z where rn<=5 group by 1,2),
r as (select query_id, kind, label, coalesce(n_applies,0)>0 as covered, coalesce(n_mentions,0) as n_mentions, coalesce(mentioned_in,'') as mentioned_in from ask left join per on kind=per.dst_type and label=per.dst_label left join top on kind=top.dst_type and label=top.dst_label) """
query("R9_scope_check", SCOPE_SQL + "select * from r")(lambda spark, sf: G.scope_check(G.asked_scope(X.asked(spark, sf)), doc_edges(spark, sf))[0])
query("R9_answerable", SCOPE_SQL + "select query_id, count(*) filter (where kind='jurisdiction' and not covered)=0 as answerable from r group by 1")(
    lambda spark, sf: G.scope_check(G.asked_scope(X.asked(spark, sf)), doc_edges(spark, sf))[1])


@query("R10_graph_counts", with_tables("inv", "bil", extra=EDGE_SQL + ", n as (select distinct tenant_id, ban from (select tenant_id, seller_ban as ban from inv union all select tenant_id, buyer_ban from inv union all select tenant_id, buyer_ban from bil union all select tenant_id, supplier_ban from bil) z)") + """
select 'node' as what, 'company' as kind, count(*) as n from n union all select 'edge', edge_type, count(*) from edges group by 2""")
def _counts(spark, sf):
    return G.counts(G.company_nodes(D.invoices(spark, sf), D.bills(spark, sf)), edges(spark, sf))


query("R11_degrees", with_tables("inv", "bil", extra=EDGE_SQL) + "select node_id, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree from (select src_id as node_id, 1 as o, 0 as i from edges union all select dst_id, 0, 1 from edges) z group by 1")(
    lambda spark, sf: G.degrees(edges(spark, sf)))
query("R11_adjacency", with_tables("inv", "bil", extra=EDGE_SQL) + """select node_id, direction, other, cast(weight as double) as weight, edge_type, tenant_id, place from (select *, row_number() over (partition by node_id, direction order by weight desc, other, edge_type, tenant_id) as place
 from (select src_id as node_id, 'out' as direction, dst_id as other, weight, edge_type, tenant_id from edges union all select dst_id, 'in', src_id, weight, edge_type, tenant_id from edges) z) y where place<=60""")(
    lambda spark, sf: G.adjacency(edges(spark, sf)))

# ---- statistics: industries are brands, years are ship years, small firms are the finished lines -------------------------


def raw_series(spark, sf):
    li, p = D.table(spark, sf, "lineitem"), D.table(spark, sf, "part")
    j = li.join(p.select("p_partkey", "p_brand"), li.l_partkey == p.p_partkey)
    name = F.concat(F.lit(" 品、牌("), F.substring("p_brand", 7, 2), F.lit(")製造業 "))
    fin, price, flag = F.col("l_linestatus") == "F", F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_returnflag")
    g = j.groupBy(name.alias("industry"), F.year("l_shipdate").alias("year"))
    both = lambda n, v: [F.sum(F.when(fin, v)).cast("double").alias(f"{n}_s"), F.sum(v).cast("double").alias(f"{n}_a")]
    g = g.agg(*both("firms", F.lit(1).cast("bigint")), *both("sales", price), *both("exports", F.when(flag == "R", price)), *both("domestic", F.when(flag == "A", price)), *both("employees", F.col("l_quantity").cast("bigint")))
    rows = F.array(*[F.struct(F.lit(k).alias("indicator"), F.col(f"{k}_s").alias("sme"), F.col(f"{k}_a").alias("all_")) for k in S.INDICATORS])
    s = g.select("industry", "year", F.explode(rows).alias("r")).select("r.indicator", "industry", "year", "r.sme", "r.all_", F.lit(2).alias("row_no"))
    # an earlier version of each row that the last one replaces, and total rows; brands ending in 5 have no staff figures
    old = s.withColumn("sme", F.lit(0.0)).withColumn("row_no", F.lit(1))
    total = s.withColumn("industry", F.lit("總計"))
    return s.union(old).union(total).where(~((F.col("indicator") == "employees") & F.contains("industry", F.lit("5)"))))


def series(spark, sf):
    return written(spark, sf, "series", lambda: S.clean_series(raw_series(spark, sf)))


def _both(n, v):
    return f"cast(sum(case when l_linestatus='F' then {v} end) as double) as {n}_s, cast(sum({v}) as double) as {n}_a"


_P = "cast(l_extendedprice as decimal(18,2))"
SERIES_SQL = f"""g as (select concat('品牌', substr(p_brand,7,2), '製造業') as industry, year(l_shipdate) as year, {_both('firms', '1')}, {_both('sales', _P)}, {_both('exports', f"case when l_returnflag='R' then {_P} end")},
  {_both('domestic', f"case when l_returnflag='A' then {_P} end")}, {_both('employees', 'cast(l_quantity as bigint)')} from lineitem join part on l_partkey=p_partkey group by 1,2),
series as ({' union all '.join(f"select '{k}' as indicator, industry, year, {k}_s as sme, {k}_a as all_ from g" + (" where not contains(industry,'5')" if k == 'employees' else '') for k in S.INDICATORS)}),
prof as (select industry, year, 100*firms_s/firms_a as sme_share, firms_s as firms, 100*sales_s/firms_s as mean_sales, 100*exports_s/nullif(sales_s,0) as export_share, 100*domestic_s/nullif(sales_s,0) as domestic_share,
  case when not contains(industry,'5') then employees_s/firms_s end as mean_staff from g)"""


@query("N1_clean_series", f"with {SERIES_SQL} select indicator, industry, year, coalesce(sme,-1) as sme, coalesce(all_,-1) as all_ from series")
def _series(spark, sf):
    return series(spark, sf).select("indicator", "industry", "year", F.coalesce("sme", F.lit(-1.0)).alias("sme"), F.coalesce("all_", F.lit(-1.0)).alias("all_"))


_COLS = ["sme_share", "mean_sales", "export_share", "domestic_share", "mean_staff"]


@query("N2_profiles", f"with {SERIES_SQL} select industry, year, firms, {', '.join(f'coalesce(round({c},6),-1) as {c}' for c in _COLS)} from prof")
def _profiles(spark, sf):
    return S.profiles(series(spark, sf), every_year=True).select("industry", "year", "firms", *[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in _COLS])


@query("N3_tags", f"with {SERIES_SQL} select industry, year, concat_ws(',', case when export_share>=30 then 'export-led' when export_share is not null then 'domestic-led' end, case when mean_sales<2000 then 'small scale' end, case when mean_staff>=10 then 'labour-intensive' end) as tags from prof")
def _tags(spark, sf):
    return S.tags(S.profiles(series(spark, sf), every_year=True))


_LAST = "last as (select * from series where year=(select max(year) from series where indicator='firms'))"
query("N4_missing", f"with {SERIES_SQL}, {_LAST}, i as (select distinct industry from last), k as (select distinct indicator from series) select i.industry, k.indicator from i cross join k where not exists (select 1 from last l where l.industry=i.industry and l.indicator=k.indicator)")(
    lambda spark, sf: S.coverage(series(spark, sf))[0])
query("N4_coverage_rate", f"with {SERIES_SQL}, {_LAST}, c as (select industry, count(distinct indicator) as n from last group by 1) select count(*) as in_any, count(*) filter (where n=5) as in_all, round(count(*) filter (where n=5)/count(*),4) as rate from c")(
    lambda spark, sf: S.coverage(series(spark, sf))[1])


@query("N5_compare", f"with {SERIES_SQL} select a.industry, a.year, b.industry as peer, round(a.mean_sales-b.mean_sales,4) as sales_gap, round(a.export_share-b.export_share,6) as export_gap from prof a join prof b on b.industry='品牌11製造業' and a.year=b.year")
def _compare(spark, sf):
    p = S.profiles(series(spark, sf), every_year=True)
    peer = p.where(F.col("industry") == "品牌11製造業").select(F.col("industry").alias("peer"), F.col("mean_sales").alias("s"), F.col("export_share").alias("e"), "year")  # one row
    return p.join(F.broadcast(peer), "year").select("industry", "year", "peer", F.round(F.col("mean_sales") - F.col("s"), 4).alias("sales_gap"), F.round(F.col("export_share") - F.col("e"), 6).alias("export_gap"))


def cells(spark, sf):
    """The series written out as one header-offset table per indicator: title, unit, header, one row per industry."""
    s = series(spark, sf)
    years = list(range(1995, 2002))
    g = s.groupBy("indicator", "industry").agg(*[F.max(F.when(F.col("year") == y, F.col("all_"))).alias(str(y)) for y in years])
    first = s.groupBy("indicator").agg(F.min("industry").alias("m"))
    body = g.withColumn("row", 2 + F.regexp_extract("industry", "([0-9]+)", 1).cast("int"))
    val = lambda y: F.coalesce(F.format_number(F.col(str(y)), 2), F.lit("-"))
    arr = F.array(F.struct(F.lit(0).alias("col"), F.col("industry").alias("text")), *[F.struct(F.lit(i + 1).alias("col"), val(y).alias("text")) for i, y in enumerate(years)])
    b = body.select(F.col("indicator").alias("source"), "row", F.explode(arr).alias("c")).select("source", "row", "c.col", "c.text")
    head = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), t.alias("text")) for r, c, t in
                     [(0, 0, F.concat(F.lit("民國 113 年 "), "indicator")), (0, 1, F.lit("")), (1, 0, F.lit("單位：元")), (1, 1, F.lit("")), (12, 0, F.lit("行業別"))] + [(12, i + 1, F.lit(f"{y}年")) for i, y in enumerate(years)]])
    h = first.select(F.col("indicator").alias("source"), F.explode(head).alias("c")).select("source", F.when(F.col("c.row") == 12, 2).otherwise(F.col("c.row")).alias("row"), "c.col", "c.text")
    return h.unionByName(b)


MELT_SQL = SERIES_SQL + """, ys as (select unnest(range(1995,2002)) as year), rowsx as (select distinct indicator, industry from series),
melted as (select r.indicator as source, r.industry as row_label, 2+cast(regexp_extract(r.industry,'[0-9]+') as int) as row, concat(cast(ys.year as varchar),'年') as "column", round(s.all_,2) as value, concat('民國 113 年 ', r.indicator) as period, '元' as unit
  from rowsx r cross join ys left join series s on s.indicator=r.indicator and s.industry=r.industry and s.year=ys.year)"""


@query("I5_header_tables", f'with {MELT_SQL} select source, row_label, "column", coalesce(value,-1) as value, period, unit from melted')
def _melt(spark, sf):
    return S.melt(cells(spark, sf)).select("source", "row_label", "column", F.coalesce("value", F.lit(-1.0)).alias("value"), "period", "unit")


@query("N6_lookup", f"""with {MELT_SQL}, k as (select distinct concat('牌', substr(p_brand,7,1)) as keyword from part), has as (select * from melted where value is not null),
r as (select keyword, source, row, row_label, row_number() over (partition by keyword order by source, row) as place from k join (select distinct source, row, row_label from has) z on contains(row_label, keyword))
select keyword, r.source, r.row_label, place, "column", value from r join has on has.source=r.source and has.row=r.row where place<=12""")
def _lookup(spark, sf):
    k = D.table(spark, sf, "part").select(F.concat(F.lit("牌"), F.substring("p_brand", 7, 1)).alias("keyword")).distinct()
    return S.lookup(S.melt(cells(spark, sf)), k).select("keyword", "source", "row_label", "place", "column", "value")


@query("N8_describe", f'with {MELT_SQL} select source, count(distinct row) as row_count, string_agg(distinct "column", \',\' order by "column") as columns, max(period) as period, max(unit) as unit, (select string_agg(row_label, \',\' order by row) from (select distinct row, row_label from melted x where x.source=m.source order by row limit 20) y) as sample from melted m group by 1')
def _describe(spark, sf):
    return S.describe(S.melt(cells(spark, sf)))


MAPNAMES = list(S.INDUSTRY_MAP)[:5] + S.TOP_LEVEL[:3] + ["其他業"]


def dist_rows(spark, sf):
    """Amounts of lines by part size, named after industries; each priority of orders is a dimension."""
    li, od = D.table(spark, sf, "lineitem"), D.table(spark, sf, "orders")
    name = F.element_at(F.array(*[F.lit(x) for x in MAPNAMES]), (F.col("l_partkey") % len(MAPNAMES) + 1).cast("int"))
    d = li.join(od.select("o_orderkey", F.col("o_orderpriority").alias("dimension")), li.l_orderkey == F.col("o_orderkey"))
    d = d.groupBy("dimension", name.alias("name")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    t = d.groupBy("dimension").agg(F.sum("amount").cast("decimal(28,2)").alias("amount")).select("dimension", F.lit("合計").alias("name"), "amount")
    return d.unionByName(t)


_NAMES = "[" + ",".join(f"'{n}'" for n in MAPNAMES) + "]"
DIST_SQL = f"""amt as (select o_orderpriority as dimension, ({_NAMES})[l_partkey%{len(MAPNAMES)}+1] as name, sum({_P}) as amount from lineitem join orders on l_orderkey=o_orderkey group by 1,2),
tot as (select dimension, sum(amount) as total from amt group by 1), leaf as (select * from amt where name not in ({','.join(repr(x) for x in S.TOP_LEVEL)})),
dist as (select leaf.dimension, name, amount, cast(amount as double)/cast(sum(amount) over (partition by leaf.dimension) as double) as weight, total from leaf join tot on tot.dimension=leaf.dimension)"""


@query("N9_distribution", f"with {DIST_SQL} select dimension, name, cast(amount as double) as amount, round(weight,8) as weight, cast(total as double) as total from dist")
def _dist(spark, sf):
    return S.distribution(dist_rows(spark, sf)).withColumn("weight", F.round("weight", 8))


_GRP = "case name " + " ".join(f"when '{k}' then '{v}'" for k, v in S.INDUSTRY_MAP.items()) + " end"


@query("N10_regrouped", f"with {DIST_SQL}, g as (select dimension, {_GRP} as grp, sum(weight) as w from dist where {_GRP} is not null group by 1,2) select dimension, grp, round(w/sum(w) over (partition by dimension),8) as weight from g")
def _regroup(spark, sf):
    return S.regroup(S.distribution(dist_rows(spark, sf)), S.INDUSTRY_MAP).withColumn("weight", F.round("weight", 8))


_IN = ",".join(f"'{k}'" for k in S.INDUSTRY_MAP)
query("N11_market_coverage", f"with {DIST_SQL} select dimension, count(*) filter (where name in ({_IN})) as n_covered, round(coalesce(sum(weight) filter (where name in ({_IN})),0),4) as covered_share, round(coalesce(sum(weight) filter (where name not in ({_IN})),0),4) as uncovered_share from dist group by 1")(
    lambda spark, sf: S.market_coverage(S.distribution(dist_rows(spark, sf)), list(S.INDUSTRY_MAP))[0])
query("N11_top_uncovered", f"with {DIST_SQL} select dimension, place, name, round(weight,4) as share from (select *, row_number() over (partition by dimension order by weight desc, name) as place from dist where name not in ({_IN})) z where place<=8")(
    lambda spark, sf: S.market_coverage(S.distribution(dist_rows(spark, sf)), list(S.INDUSTRY_MAP))[1])

query("R5_industry_edges", f"with {SERIES_SQL} select {NID('industry', 'industry')} as src_id, {NID('period', 'cast(year as varchar)')} as dst_id, 'applies_to' as edge_type, 'SHARED' as tenant_id, 1.0 as weight, industry as label from prof")(
    lambda spark, sf: G.industry_edges(S.profiles(series(spark, sf), every_year=True)))
