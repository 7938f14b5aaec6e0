"""Registered queries for sources, sinks and streams (I, X)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import ids
from ..operators import questions as Q, statistics as S
from ..session import shared_path, written
from ..sources import casefiles as CF, corpus as K, driver_tables as D
from ..streaming import monitor as M
from . import texts as X
from .adapters_sql import with_tables
from .case_metrics import CASES_SQL, cases
from .graph_queries import SERIES_SQL, series
from .registry import query

_ONCE: set[tuple[str, str]] = set()


def once(spark, path: str, fn) -> str:
    """Write files once per application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _ONCE:
        fn(path)
        _ONCE.add(key)
    return path


@query("I1_json_cases", """select concat('CASE-', cast(o_custkey%100 as varchar)) as tenant_id, o_orderkey, unnest(case when o_orderkey%3=0 then [1] else [1,2] end) as seq,
  unnest(case when o_orderkey%3=0 then [concat('N', cast(o_orderkey as varchar))] else [concat('N', cast(o_orderkey as varchar)), concat('N', cast(o_orderkey as varchar), 'b')] end) as invoice_number from orders""")
def _json(spark, sf):
    o = D.table(spark, sf, "orders")
    row = lambda tail: F.struct(F.concat(F.lit("N"), F.col("o_orderkey").cast("string"), F.lit(tail)).alias("invoice_number"), F.col("o_orderkey").cast("string").alias("status"))
    body = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("﻿"), F.to_json(row("")))).otherwise(F.to_json(F.array(row(""), row("b"))))
    files = o.select(F.concat(F.lit("/raw/CASE-"), (F.col("o_custkey") % 100).cast("string"), F.lit("/receivables.json")).alias("path"), body.alias("content"))
    return CF.parse_json_files(files, CF.INVOICE).select("tenant_id", F.col("status").cast("bigint").alias("o_orderkey"), "seq", "invoice_number")


@query("I2_ledger_csv", with_tables("led") + "select tenant_id, seq, cast(txn_date as varchar) as date, case when reference='' then 'none' else reference end as reference, case when seq%50=0 then 0 else cast(amount as double) end as amount, cast(balance as double) as balance from led")
def _csv(spark, sf):
    led = D.ledger(spark, sf)
    out = led.select(F.concat_ws("/", "tenant_id", "seq").alias("description"), F.col("txn_date").alias("date"), F.when(F.col("reference") == "", "none").otherwise(F.col("reference")).alias("reference"),
                     F.when(F.col("seq") % 50 == 0, "n.a.").otherwise(F.format_number("amount", 2)).alias("amount"), F.col("balance").cast("string").alias("balance"))
    p = once(spark, shared_path(spark, sf, "ledger_csv"), lambda p: out.write.mode("overwrite").csv(p, header=True))
    d = CF.read_ledger_csv(spark, p)
    return d.select(F.split_part("description", F.lit("/"), F.lit(1)).alias("tenant_id"), F.split_part("description", F.lit("/"), F.lit(2)).cast("bigint").alias("seq"), "date", "reference", "amount", "balance")


@query("I3_json_lines", "select conv_id*1000000+turn as id, role, length(text) as n from conversations")
def _lines(spark, sf):
    c = D.table(spark, sf, "conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("id"), "role", "text")
    p = once(spark, shared_path(spark, sf, "turns_jsonl"), lambda p: CF.write_json(c, p))
    return CF.read_json_lines(spark, p, "id bigint, role string, text string").select("id", "role", F.length("text").alias("n"))


@query("I4_statistics_csv", f"with {SERIES_SQL} select indicator, industry, year, coalesce(round(sme*case when indicator='employees' then 1000 else 1 end,2),-1) as sme, coalesce(round(all_*case when indicator='employees' then 1000 else 1 end,2),-1) as all_ from series")
def _stats(spark, sf):
    s = series(spark, sf)

    def save(folder):
        for k, (name, _) in CF.STATISTIC_FILES.items():
            s.where(F.col("indicator") == k).select(F.col("year").alias("年度"), F.col("industry").alias("行業別"), F.format_number("sme", 2).alias("中小企業(單位)"), F.format_number("all_", 2).alias("全部企業(單位)")) \
                .write.mode("overwrite").csv(f"{folder}/{name}", header=True)

    d = S.clean_series(CF.read_statistics(spark, once(spark, shared_path(spark, sf, "statistics_csv"), save)))
    return d.select("indicator", "industry", "year", F.coalesce(F.round("sme", 2), F.lit(-1.0)).alias("sme"), F.coalesce(F.round("all_", 2), F.lit(-1.0)).alias("all_"))


@query("I6_award_notices", """with o as (select *, strftime(cast(o_orderdate as date), '%Y%m%d') as dt from orders where o_orderstatus<>'P'), b as (select *, unnest([1,2,3]) as n from o),
w as (select *, cast(o_custkey*104729%79999999+20000000+n as varchar) as ban, n=1 or (n=2 and o_orderkey%2=0) as won from b)
select concat('PCC-', cast(o_orderkey as varchar), '-', cast(n as varchar)) as invoice_number, case when o_orderkey%4=0 then '1998-05-13' else cast(cast(o_orderdate as date) as varchar) end as invoice_date, ban as seller_ban,
 case when n=1 and o_orderkey%5=0 then cast(floor(o_totalprice) as double) when n=1 then cast(floor(o_totalprice/2) as double) else cast(floor(o_totalprice) as double) end as total_amount, case when n=1 then '2024-01-02' else '' end as contract_start from w where won""")
def _awards(spark, sf):
    o = D.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    whole = lambda v: F.format_number(F.floor(v).cast("bigint"), 0)
    pre = lambda n, f: F.lit(f"投標廠商:投標廠商{n}:{f}")
    ban = lambda n: (F.col("o_custkey") * 104729 % 79999999 + 20000000 + n).cast("string")
    m = F.map_concat(
        F.create_map(F.lit("決標資料:總決標金額"), F.concat(whole(F.col("o_totalprice")), F.lit("元")), pre(1, "廠商代碼"), ban(1), pre(1, "是否得標"), F.lit("是"), pre(1, "履約起迄日期"), F.lit("113/01/02-114/02/03"),
                     pre(2, "廠商代碼"), ban(2), pre(2, "是否得標"), F.when(k % 2 == 0, "是").otherwise("否"), pre(3, "廠商代碼"), ban(3), pre(3, "是否得標"), F.lit("否")),
        F.when(k % 5 == 0, F.create_map(F.lit("x"), F.lit("y"))).otherwise(F.create_map(pre(1, "決標金額"), F.concat(whole(F.col("o_totalprice") / 2), F.lit("元")))),
        F.when(k % 4 == 0, F.create_map(F.lit("已公告資料:公告日"), F.lit("87/05/13"))).otherwise(F.create_map(F.lit("z"), F.lit(""))))
    n = o.select(k.cast("string").alias("job_number"), F.lit(None).cast("string").alias("unit_name"), F.when(F.col("o_orderstatus") == "P", "招標公告").otherwise("決標公告").alias("type"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), m.alias("detail"))
    return CF.parse_awards(n).select("invoice_number", "invoice_date", "seller_ban", "total_amount", F.coalesce(F.col("contract_start").cast("string"), F.lit("")).alias("contract_start"))


@query("I7_loan_csv", "select concat('B', cast(o_custkey as varchar)) as BorrName, o_orderpriority as BusinessType, case when o_orderstatus='F' then 'PIF' else 'CHGOFF' end as LoanStatus, cast(o_orderkey as varchar) as Term from orders")
def _loan_csv(spark, sf):
    o = D.table(spark, sf, "orders")
    wide = o.select(F.lit("x").alias("Program"), F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("BorrName"), F.lit("unused").alias("BankName"), F.col("o_orderpriority").alias("BusinessType"),
                    F.when(F.col("o_orderstatus") == "F", "PIF").otherwise("CHGOFF").alias("LoanStatus"), F.col("o_orderkey").alias("Term"), F.lit("y").alias("Extra"))
    p = once(spark, shared_path(spark, sf, "loans_csv"), lambda p: wide.write.mode("overwrite").csv(p, header=True))
    return CF.read_loans(spark, p).select("BorrName", "BusinessType", "LoanStatus", "Term")


@query("I8_page_texts")
def _pages(spark, sf):
    return K.page_texts(D.table(spark, sf, "pages"))


@query("I9_manifest", "select path, status from (select concat('doc-', cast(doc_id as varchar)) as path, case when doc_id%10=0 then 'new' when doc_id%10=1 then 'changed' else 'unchanged' end as status from documents union all select concat('gone-', cast(doc_id as varchar)), 'removed' from documents where lang='de') z")
def _manifest(spark, sf):
    d = D.table(spark, sf, "documents")
    path = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    now = d.select(path.alias("path"), F.sha2("text", 256).alias("sha"))
    m = F.col("doc_id") % 10
    old = d.where(m != 0).select(path.alias("path"), F.when(m == 1, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("sha"))
    gone = d.where("lang = 'de'").select(F.concat(F.lit("gone-"), F.col("doc_id").cast("string")).alias("path"), F.lit("0").alias("sha"))
    return K.manifest_changes(now, old.union(gone))


@query("I10_drop_copies", "select min(path) as path from (select printf('p%08d', doc_id) as path, sha256(text) as sha from documents where doc_id<>3) z group by sha")
def _copies(spark, sf):
    d = D.table(spark, sf, "documents")
    f = d.select(F.format_string("p%08d", F.col("doc_id").cast("bigint")).alias("path"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.sha2("text", 256).alias("sha"))
    return K.drop_copies(f, ["d3"]).select("path")


NAMES = ["4_直接信用保證要點", "白皮書 (2)", "應收承購 - 中國信託", "財團法人中小企業信用保證基金規章", "承保統計11501", "發展條例2024", "ledger export", "作業手冊 (1)", "電子發票建置指引", "年報 2023 summary"]
RULES = [{"match": "條例", "category": "法規", "publisher": "全國法規資料庫", "status": "current", "authority": 1}, {"match": "保證要點|作業手冊", "category": "融資商品說明", "publisher": "中小企業信用保證基金", "status": "current", "authority": 2},
         {"match": "承保統計", "category": "白皮書統計", "publisher": "中小企業信用保證基金", "status": "current", "authority": 3}, {"match": "電子發票", "category": "法規", "publisher": "財政部", "status": "current", "authority": 1, "published": "2020-01"},
         {"match": "^白皮書|年報", "category": "白皮書統計", "publisher": "經濟部中小及新創企業署", "status": "reference", "authority": 4}]


def names(spark, sf):
    """File names: a title, a title and the first line of the text, or the line and the title."""
    d = D.table(spark, sf, "documents")
    name, line = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("doc_id") % len(NAMES) + 1).cast("int")), F.coalesce(F.split("text", "\n")[0], F.lit(""))  # as concat of the SQL reads a missing text
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, name).when(F.col("doc_id") % 3 == 1, F.concat_ws(" ", name, line)).otherwise(F.concat_ws(" ", line, name)).alias("stem"))


_NAME_SQL = "n0 as (select doc_id, ([" + ",".join(f"'{x}'" for x in NAMES) + f"])[doc_id%{len(NAMES)}+1] as name, string_split(text, chr(10))[1] as line from documents), n as (select doc_id, case doc_id%3 when 0 then name when 1 then concat(name, ' ', line) else concat(line, ' ', name) end as stem from n0)"
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(stem, '^\d+_', ''), '\s*\(\d+\)$', ''), '\s*-\s*中國信託$', '（中國信託）'), '^財團法人中小企業信用保證基金', '信保基金-'))"


@query("I10_name_rules", f"with {_NAME_SQL}, m as (select doc_id, {_NORM} as s from n) select doc_id, case when not starts_with(s,'信保基金-') and ({' or '.join(f'contains(s,{chr(39)}{w}{chr(39)})' for w in K.FUND_DOCS)}) then '信保基金-' || s else s end as name from m")
def _name_rules(spark, sf):
    return names(spark, sf).select("doc_id", K.norm_stem(F.col("stem")).alias("name"))


@query("I11_typed_projection", """select concat('CASE-', cast(o_custkey%100 as varchar)) as tenant_id, o_orderkey as seq, concat('N', cast(o_orderkey as varchar)) as invoice_number, case when o_orderkey%7=0 then '' else cast(cast(o_orderdate as date) as varchar) end as issue_date,
  round(cast(o_totalprice as decimal(18,2)),2)::double as total_amount, o_orderstatus as status from orders""")
def _typed(spark, sf):
    o = D.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = o.select(F.concat(F.lit("CASE-"), (F.col("o_custkey") % 100).cast("string")).alias("tenant_id"), k.alias("seq"), F.concat(F.lit("N"), k.cast("string")).alias("invoice_number"),
                   F.when(k % 7 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("invoice_date"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2).alias("total_amount"), F.col("o_orderstatus").alias("status"))
    d = CF.project(raw, CF.INVOICE_MAP)
    return d.select("tenant_id", "seq", "invoice_number", F.coalesce(F.col("issue_date").cast("string"), F.lit("")).alias("issue_date"), "total_amount", "status")


@query("I12_replace_load", with_tables("inv") + "select tenant_id, count(distinct invoice_number) as n from inv group by 1")
def _replace(spark, sf):
    return CF.replace_cases(D.invoices(spark, sf), shared_path(spark, sf, "fin_invoices"), "invoice_number")


@query("I13_chunk_upsert", "with s as (select source, doc_id as chunk_index, 'old' as v from documents where lang in ('en','fr')), f as (select source, doc_id as chunk_index, 'new' as v from documents where source in (select source from documents where lang='de')) select * from s where source not in (select source from f) union all select * from f")
def _upsert(spark, sf):
    d = D.table(spark, sf, "documents").select("source", F.col("doc_id").alias("chunk_index"), "lang")
    fresh = d.join(d.where("lang = 'de'").select("source").distinct(), "source", "left_semi")
    return K.upsert_chunks(d.where("lang in ('en','fr')").select("source", "chunk_index", F.lit("old").alias("v")), fresh.select("source", "chunk_index", F.lit("new").alias("v")))


_RULE = "case " + " ".join(f"when regexp_matches(stem,'{r['match']}') then {i}" for i, r in enumerate(RULES)) + " end"


@query("I14_registry", f"""with {_NAME_SQL}, r as (select doc_id, stem, {_RULE} as rule from n) select doc_id, coalesce(rule,-1) as rule, coalesce(([{",".join(f"'{r['category']}'" for r in RULES)}])[rule+1],'') as category,
  coalesce(case when rule=3 then '2020-01' when rule is null then null when stem like '%11501' then '2026-01' when regexp_matches(stem,'20\\d{{2}}') then regexp_extract(stem,'20\\d{{2}}') end,'') as published from r""")
def _registry(spark, sf):
    n = names(spark, sf)
    d = K.register(n.select(F.concat_ws("|", "doc_id", "stem").alias("key"), F.col("stem").alias("name"), "stem").withColumnRenamed("key", "k").drop("k").distinct(), RULES)
    return n.join(d, n.stem == d.name).select("doc_id", F.coalesce("rule", F.lit(-1)).alias("rule"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("published", F.lit("")).alias("published"))


_CAT = "coalesce(" + ", ".join(f"case when {' or '.join(f'contains(lower(stem),{chr(39)}{w.lower()}{chr(39)})' for w in ws)} then '{k}' end" for ws, k in K.CATEGORY_RULES) + ", case when doc_id%3=0 then '白皮書統計' end, '企業自有文件')"


@query("I15_categories", f"with {_NAME_SQL} select doc_id, {_CAT} as category from n")
def _categories(spark, sf):
    return names(spark, sf).select("doc_id", K.category(F.col("stem"), F.when(F.col("doc_id") % 3 == 0, ".CSV").otherwise(".md")).alias("category"))


def dirty(spark, sf):
    d = D.table(spark, sf, "documents")
    plain = F.regexp_replace("text", r"[`$=_-]", "")
    return d.select("doc_id", "source", "lang", F.concat(F.lit("Page 3 of 9\n- 12 -\n第 4 頁，共 9 頁\n# 章\n"), plain, F.lit("  \t\n=====\n\n\n\n```\nkeep   \n\n\n\n- 1 -\n```\nend\u0007 $$a\n\n\n\nb$$")).alias("text"))


@query("I16_clean_text", r"""select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(concat('', chr(10), chr(10), '# 章', chr(10), regexp_replace(text,'[`$=_-]','','g'), '  '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '[ \t\r\x{00a0}\x{3000}]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g'))
  || concat(chr(10), chr(10), '```', chr(10), 'keep   ', chr(10), chr(10), chr(10), chr(10), '- 1 -', chr(10), '```', chr(10), 'end $$a', chr(10), chr(10), chr(10), chr(10), 'b$$')) as h from documents""")
def _clean(spark, sf):
    return dirty(spark, sf).select("doc_id", F.md5(K.clean_text(F.col("text"))).alias("h"))


@query("I17_chunks")
def _chunks(spark, sf):
    d = dirty(spark, sf).select(F.concat_ws("/", "source", "doc_id").alias("source"), F.col("lang").alias("category"), K.clean_text(F.col("text")).alias("text"))
    return K.chunk(d)


@query("I18_profile_numbers", """select * from (select 'c_custkey' as "column", count(*) as n, min(c_custkey)::double as min, max(c_custkey)::double as max, sum(c_custkey)::double as sum, round(avg(c_custkey),6) as mean from customer union all
 select 'c_nationkey', count(*), min(c_nationkey), max(c_nationkey), sum(c_nationkey)::double, round(avg(c_nationkey),6) from customer union all select 'c_acctbal', count(*), min(c_acctbal), max(c_acctbal), sum(c_acctbal::decimal(28,4))::double, round(sum(c_acctbal::decimal(28,4))::double/count(*),6) from customer) z""")
def _profile(spark, sf):
    return K.table_profile(D.table(spark, sf, "customer"))[0].withColumn("mean", F.round(F.col("mean").cast("double"), 6))


@query("I18_profile_values", """select "column", value, n, place from (select *, row_number() over (partition by "column" order by n desc, value) as place from (select 'c_name' as "column", c_name as value, count(*) as n from customer group by 2 union all select 'c_mktsegment', c_mktsegment, count(*) from customer group by 2) z) y where place<=8""")
def _profile_values(spark, sf):
    return K.table_profile(D.table(spark, sf, "customer"))[1]


@query("I19_verbalise", with_tables("bil") + "select tenant_id, seq, '- 應付 ' || bill_number || '：應付予 ' || supplier_name || '（統編 ' || supplier_ban || '）NT$' || cast(amount as varchar) || '，到期 ' || cast(due_date as varchar) || '，狀態 ' || status || '。' as line from bil")
def _verbalise(spark, sf):
    return CF.verbalise(D.bills(spark, sf), "AP_BILL")


@query("I20_json_sink", "select o_orderstatus, count(*) as n, sum(o_totalprice::decimal(18,2))::double as total from orders group by 1")
def _sink(spark, sf):
    rep = D.table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    p = once(spark, shared_path(spark, sf, "report_json"), lambda p: CF.write_json(rep, p))
    return spark.read.schema("o_orderstatus string, n bigint, total decimal(28,2)").json(p)


@query("I21_inventory", f"with {X.CHUNKS_SQL} select source, category, count(*) as n_chunks, sum(length(text))::bigint as n_chars from chunks group by 1,2")
def _inventory(spark, sf):
    return K.inventory(X.chunks(spark, sf))


@query("I21_case_inventory", "with " + CASES_SQL + ", c as (select printf('CASE-%04d', doc_id%150) as tenant_id, source from documents) select k.tenant_id, client_name, coalesce(d,0) as documents, coalesce(n,0) as chunks from cases k left join (select tenant_id, count(distinct source) as d, count(*) as n from c group by 1) x on x.tenant_id=k.tenant_id")
def _case_inventory(spark, sf):
    c = D.table(spark, sf, "documents").select(F.format_string("CASE-%04d", (F.col("doc_id") % 150).cast("bigint")).alias("tenant_id"), "source")
    return K.case_inventory(cases(spark, sf).select("tenant_id", "client_name"), c)


# ---- streams: each runs over the whole table once and is compared with its batch form -------------------------------------------

def event_stream(spark, sf):
    """The events table as a stream."""
    e = D.table(spark, sf, "events").select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("tenant_id"), F.col("ts").cast("timestamp").alias("ts"))
    p = once(spark, shared_path(spark, sf, "event_files"), lambda p: e.write.mode("overwrite").parquet(p))
    return spark.readStream.schema(e.schema).parquet(p)


@query("X1_window_rates", "select actor, tenant_id, epoch(s)::bigint as start, count(*) as n from (select user_id as actor, event_type as tenant_id, unnest(range(time_bucket(interval 6 hour, ts) - interval 6 hour, ts + interval 1 microsecond, interval 6 hour)) as s, ts from events) z where s <= ts and ts < s + interval 12 hour group by 1,2,3 having count(*)>3")
def _windows(spark, sf):
    path = shared_path(spark, sf, "x1_windows")

    def run(p):
        M.drain_to_table(M.window_rates(event_stream(spark, sf), "60 days", "12 hours", "6 hours", 3), p, shared_path(spark, sf, "x1_progress"))

    d = spark.read.parquet(once(spark, path, run))
    return d.groupBy("actor", "tenant_id", F.unix_timestamp("start").alias("start")).agg(F.max("n").alias("n"))


UNIT = 3 * 86_400
UNIT_SQL = f"floor((epoch(ts) - epoch(timestamp '2024-01-01')) / {UNIT})"


def feed_in_disorder(spark, path):
    """The events table in files by three days, one file a batch: every third event comes a file late, which the watermark allows,
    and every fiftieth of the first eighteen days four files late, which it does not. A clock row at the end moves the watermark past all."""
    def write(sf):
        e = D.table(spark, sf, "events").select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("tenant_id"), F.col("ts").cast("timestamp").alias("ts"))
        unit = F.floor((F.unix_seconds("ts") - F.lit(1_704_067_200)) / UNIT)
        e = e.withColumn("file", F.when((F.col("event_id") % 50 == 0) & (unit <= 5), unit + 4).when(F.col("event_id") % 3 == 0, unit + 1).otherwise(unit))
        e.write.mode("overwrite").partitionBy("file").parquet(f"{path}_files")  # read once, by all tasks
        staged = spark.read.schema(e.schema).parquet(f"{path}_files")
        for k in sorted(r.file for r in staged.select("file").distinct().collect()):  # a file for each of the three days
            staged.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(path)
        clock = e.agg((F.max("ts") + F.expr("interval 60 days")).alias("ts"))
        clock.select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast(dict(e.dtypes)["actor"]).alias("actor"), F.lit("clock").alias("tenant_id"), "ts").write.mode("append").parquet(path)
    return write


@query("X1_trailing_rates", f"""select event_id, actor, tenant_id, n_recent from (select event_id, user_id as actor, event_type as tenant_id,
  count(*) over (partition by user_id, event_type order by ts range between interval 36000 second preceding and current row) as n_recent
  from events where not (event_id % 50 = 0 and {UNIT_SQL} <= 5)) z where n_recent > 3""")
def _trailing(spark, sf):
    feed = once(spark, shared_path(spark, sf, "x1_feed"), lambda p: feed_in_disorder(spark, p)(sf))
    out = shared_path(spark, sf, "x1_trailing")
    schema = spark.read.parquet(feed).schema

    def run(progress):
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        M.drain_to_table(M.trailing_rates(log, 36000, 3, f"{UNIT} seconds"), out, progress, "append")

    once(spark, shared_path(spark, sf, "x1t_progress"), run)
    return spark.read.parquet(out).drop("batch")


from .case_metrics import HEAD_SQL  # noqa: E402


@query("X2_alert_stream", with_tables("inv", "con", extra=HEAD_SQL) + "select tenant_id, rule_id, fingerprint, severity from heads")
def _alerts(spark, sf):
    return alert_store(spark, sf).read().select("tenant_id", "rule_id", "fingerprint", "severity")


@query("X2_new_alerts", with_tables("inv", "con", extra=HEAD_SQL) + "select distinct tenant_id, rule_id, fingerprint from heads")
def _new(spark, sf):
    """First sightings from the log of the store, in which every alert stands twice."""
    out = shared_path(spark, sf, "x2_new")
    once(spark, shared_path(spark, sf, "x2_new_progress"), lambda p: M.drain_to_table(M.new_alerts(alert_store(spark, sf).sightings()), out, p, "append"))
    return spark.read.parquet(out).select("tenant_id", "rule_id", "fingerprint")


def alert_store(spark, sf):
    """Three batches of changed invoices; each case is in two of them. The change log names the invoices, whose rows are in the case tables."""
    log = D.invoices(spark, sf).select("tenant_id", "seq")
    third = F.pmod(F.xxhash64("tenant_id"), F.lit(3))

    def write(p):
        for k in range(3):
            log.where((third == k) | (third == (k + 1) % 3)).coalesce(1).write.mode("append").parquet(p)

    feed = once(spark, shared_path(spark, sf, "x2_feed"), write)
    store = M.AlertStore(spark, shared_path(spark, sf, "x2_store"), least=100)

    def run(p):
        changed = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(feed)
        M.alert_stream(changed, lambda: D.invoices(spark, sf), lambda: D.contracts(spark, sf), store, D.AS_OF, p)

    once(spark, shared_path(spark, sf, "x2_progress"), run)
    return store


@query("X3_document_ingest")
def _ingest(spark, sf):
    # a glob of just this name, since a stream takes a folder or a glob and the table may be one file
    feed = spark.readStream.schema(D.table(spark, sf, "documents").schema).parquet(f"{sf}/documents.parque[t]")
    docs = feed.select(F.concat_ws("/", "source", "doc_id").alias("source"), F.col("lang").alias("category"), "text", F.lit("2024-01-01").cast("timestamp").alias("seen_at"))
    out = shared_path(spark, sf, "x3_out")
    once(spark, shared_path(spark, sf, "x3_progress"), lambda p: M.ingest_stream(docs, out, p))
    return M.current_chunks(spark, out).groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"))
