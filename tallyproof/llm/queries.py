"""Registered queries of this package: ``opN_<name>`` applies operator N to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.llm import alignment, decontaminate, exact, jaccard, language, licenses, line_dedup, packing, periodic, quality, repeats, secret_scan, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


EXACT_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') bare, length(coalesce(text, '')) points from documents),
k as (select doc_id, bare, first_value(doc_id) over (partition by bare order by points desc, doc_id) keep_id, count(*) over (partition by bare) group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(bare) as text_sha256, cast(octet_length(encode(bare)) as bigint) as n_bytes from k
"""


@query("op2_exact_dedup", EXACT_SQL)
def _(spark, sf):
    return exact.exact_dedup(table(spark, sf, "documents")).drop("row")


@query("op5_best_two_fit")
def _(spark, sf):
    return packing.packed(table(spark, sf, "documents"), tokenizer())


@query("op8_token_files")
def _(spark, sf):
    return token_files.read(spark, token_files.write(table(spark, sf, "documents"), tokenizer()))


BENCH_SQL = r"""
with recursive low as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
d as (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from low),
b as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(13, len(w)) n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') k from b, range(1, 1 + greatest(1, len(w) - 12)) r(i) where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') k from d, sizes, range(1, len(w) - n + 2) r(i)),
hits as (select doc_id, i, dw.n, item_id from dw join bw using (n, k)),
pos as (select doc_id, count(distinct p) n_hit from hits, range(i, i + n) r(p) group by 1),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) ids from hits group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (doc_id) left join its using (doc_id)
"""


@query("op3_fm_decontamination", BENCH_SQL)
def _(spark, sf):
    found = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.drop("spans", "items")


LINES_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
h as (select *, ('0x' || substr(md5(s), 1, 7))::bigint h, len(string_split(s, ' ')) > 50 long from l),
q as (select *, (coalesce(lag(h) over w, 0) % 2147483647 * 1000003 + h) % 2147483647 r from h window w as (partition by doc_id order by i)),
r as (select *, coalesce(r < lag(r) over w and r < lead(r) over w, false) or long or coalesce(lead(long) over w, false) ends from q window w as (partition by doc_id order by i)),
c as (select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) c from r),
p as (select doc_id, c, min(i) low, count(*) n, string_agg(s, chr(10) order by i) body, bool_or(long) long from c group by 1, 2),
k as (select *, row_number() over (partition by body order by doc_id, low) place from p where (n >= 2 or long) and trim(body, ' ') <> ''),
gone as (select doc_id, c, n from k where place > 1),
kept as (select doc_id, string_agg(s, chr(10) order by i) t from c anti join gone using (doc_id, c) group by 1),
total as (select doc_id, count(*) n_lines from l group by 1),
lost as (select doc_id, count(*) n_removed_chunks, cast(sum(n) as bigint) n_removed_lines from gone group by 1)
select doc_id, n_lines, coalesce(n_removed_chunks, 0) n_removed_chunks, coalesce(n_removed_lines, 0) n_removed_lines, cast(length(coalesce(t, '')) as bigint) n_chars, sha256(coalesce(t, '')) text_sha256
from total left join lost using (doc_id) left join kept using (doc_id)
"""


@query("op10_line_dedup", LINES_SQL)
def _(spark, sf):
    kept = line_dedup.line_dedup(table(spark, sf, "documents"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


RUNS_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from documents),
p as (select doc_id, i, s, s || chr(10) || lead(s) over (partition by doc_id order by i) pair, len(string_split(s, ' ')) > 50 long from l),
b as (select doc_id, i, 1 more, pair body from p where pair is not null union all select doc_id, i, 0, s from p where long),
k as (select *, row_number() over (partition by body order by doc_id, i) place from b where trim(body, chr(32) || chr(9) || chr(10) || chr(13)) <> ''),
gone as (select distinct doc_id, unnest(range(i, i + more + 1)) i from k where place > 1),
kept as (select doc_id, string_agg(s, chr(10) order by i) t from p anti join gone using (doc_id, i) group by 1),
total as (select doc_id, count(*) n_lines from l group by 1),
lost as (select doc_id, count(*) filter (where before is null or before < i - 1) n_removed_chunks, count(*) n_removed_lines
  from (select doc_id, i, lag(i) over (partition by doc_id order by i) before from gone) group by 1)
select doc_id, n_lines, coalesce(n_removed_chunks, 0) n_removed_chunks, coalesce(n_removed_lines, 0) n_removed_lines, cast(length(coalesce(t, '')) as bigint) n_chars, sha256(coalesce(t, '')) text_sha256
from total left join lost using (doc_id) left join kept using (doc_id)
"""


@query("op10_line_runs", RUNS_SQL)
def _(spark, sf):
    kept = line_dedup.line_runs(table(spark, sf, "documents"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", F.length(text).cast("bigint").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


LICENSE_SQL = r"""
with t as (select * from (values %s) v(license, template, body)),
w as (select license, template, regexp_extract_all(lower(body), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from t),
tp as (select license, template, len(w) - 1 size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) pair from w),
tc as (select license, template, size, pair, count(*) uses from tp group by all),
u as (select distinct doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n'), [text])) u from documents),
uw as (select doc_id, u, regexp_extract_all(lower(u), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from u),
up as (select doc_id, u, len(w) - 1 n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) pair from uw where len(w) between 2 and 400),
uc as (select doc_id, u, n, pair, count(*) own from up group by all),
s as (select doc_id, u, license, template, 2.0::double * sum(least(own, uses)) / (n + size) dice from uc join tc using (pair) group by doc_id, u, license, template, n, size),
f as (select doc_id, license, max(dice) dice from s where dice >= 0.8 group by 1, 2),
b as (select doc_id, arg_min(license, (-dice, license)) license, max(dice) dice, count(*) n_licenses, string_agg(license, ',' order by license) licenses from f group by 1)
select doc_id, license, dice, coalesce(n_licenses, 0) n_licenses, coalesce(licenses, '') licenses from documents left join b using (doc_id)
""" % ", ".join("('%s', %d, '%s')" % (a, i, b.replace("'", "''")) for i, (a, b) in enumerate(licenses.TEMPLATES))


@query("op6_license_dice", LICENSE_SQL)
def _(spark, sf):
    return licenses.licenses(table(spark, sf, "documents")).withColumn("licenses", F.concat_ws(",", "licenses"))


IDENTITY_SQL = "array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(array_to_string(w, ' '), '%s'), lambda x: regexp_replace(x, '^v', '')))), ',')" % licenses.IDENTITY
NOTICE_SQL = r"""
with t as (select * from (values %s) v(license, template, body)),
w as (select license, template, regexp_extract_all(lower(body), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from t),
tp as (select license, template, IDENTITY named, len(w) - 1 size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) pair from w),
tc as (select license, template, named, size, pair, count(*) uses from tp group by all),
u as (select distinct doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n'), [text])) u from documents),
uw as (select doc_id, u, regexp_extract_all(lower(u), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from u),
up as (select doc_id, u, IDENTITY named, len(w) - 1 n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) pair from uw where len(w) between 2 and 400),
uc as (select doc_id, u, named, n, pair, count(*) own from up group by all),
s as (select doc_id, u, license, template, size, 2.0::double * sum(least(own, uses)) / (n + size) dice from uc join tc using (named, pair) group by doc_id, u, license, template, n, size),
o as (select *, row_number() over (partition by doc_id, u order by dice desc, size desc, license) place from s where dice >= 0.8),
f as (select doc_id, license, max(dice) dice from o where place = 1 group by 1, 2),
b as (select doc_id, arg_min(license, (-dice, license)) license, max(dice) dice, count(*) n_licenses, string_agg(license, ',' order by license) licenses from f group by 1)
select doc_id, license, dice, coalesce(n_licenses, 0) n_licenses, coalesce(licenses, '') licenses from documents left join b using (doc_id)
""".replace("IDENTITY", IDENTITY_SQL.replace("%", "%%")) % ", ".join("('%s', %d, '%s')" % (a, i, b.replace("'", "''")) for i, (a, b) in enumerate(licenses.NOTICES))


@query("op6_license_notices", NOTICE_SQL)
def _(spark, sf):
    return licenses.licenses(table(spark, sf, "documents"), licenses.NOTICES, alike=True).withColumn("licenses", F.concat_ws(",", "licenses"))


JACCARD_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) g from w where len(w) > 0),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
both_ways as (select a, b from e union all select b, a from e),
r as (select doc_id, doc_id to_id from documents union select r.doc_id, both_ways.b from r join both_ways on r.to_id = both_ways.a)
select doc_id, coalesce(any_value(n.n), 0) n_shingles, min(to_id) component_id from r left join n using (doc_id) group by 1
"""


@query("op7_group_jaccard", JACCARD_SQL)
def _(spark, sf):
    return jaccard.similar(table(spark, sf, "documents"), n_words=3, percent=90).drop("row")


@query("op9_site_quality")
def _(spark, sf):
    found = quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return found.drop("row")


@query("op1_subword_language")
def _(spark, sf):
    return language.identify(table(spark, sf, "documents"))


@query("op4_crf_secrets")
def _(spark, sf):
    return secret_scan.digest(secret_scan.scan(table(spark, sf, "documents")))


PASSAGES_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
p as (select doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) k from w, range(1, len(w) - 18) r(i)),
k as (select doc_id, i, row_number() over (partition by k order by doc_id, i) place from p),
gone as (select distinct doc_id, unnest(range(i, i + 20)) i from k where place > 1),
l as (select doc_id, unnest(w) s, generate_subscripts(w, 1) i from w),
kept as (select doc_id, string_agg(s, ' ' order by i) t from l anti join gone using (doc_id, i) group by 1),
lost as (select doc_id, count(*) n from gone group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256
from w left join lost using (doc_id) left join kept using (doc_id)
"""


@query("op11_repeated_passages", PASSAGES_SQL)
def _(spark, sf):
    return repeats.digest(repeats.repeated_passages(table(spark, sf, "documents")))


@query("op12_token_alignment")
def _(spark, sf):
    return alignment.align(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query("op13_periodic_runs")
def _(spark, sf):
    return periodic.digest(periodic.periodic_runs(periodic.looped(table(spark, sf, "documents"))))
