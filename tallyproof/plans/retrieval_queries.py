"""Registered queries for the text index and retrieval (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import query_terms, tokens
from ..operators import retrieval as R, vector_index as V
from . import texts as X
from .registry import query

TOK = X.tokens_sql("q")
DOC_TOK = X.tokens_sql("concat(category, ' ', text)")


@query("T1_tokens", f"with {X.ASKED_SQL} select query_id, len(t) as n, array_to_string(t, ' ') as toks from (select query_id, {TOK} as t from asked) z")
def _tokens(spark, sf):
    return X.asked(spark, sf).select("query_id", tokens(F.col("q")).alias("t")).select("query_id", F.size("t").alias("n"), F.array_join("t", " ").alias("toks"))


POST = f"post as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest({DOC_TOK}) as term from chunks) z group by 1,2)"


@query("T2_term_stats", f"with {X.CHUNKS_SQL}, {POST} select term, count(*) as df, cast(sum(tf) as bigint) as cf from post group by 1")
def _terms(spark, sf):
    return R.term_stats(R.postings(X.chunk_texts(spark, sf)))


@query("T2_chunk_lengths", f"with {X.CHUNKS_SQL} select chunk_id, len({DOC_TOK}) as length from chunks")
def _lengths(spark, sf):
    return R.chunk_lengths(X.chunk_texts(spark, sf))


QT = f"""qt as (select query_id, unnest(list_slice(list_distinct_ordered, 1, 64)) as term from (
  select query_id, list_transform(list_filter(list_zip(t, range(1, len(t)+1)), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1]) as list_distinct_ordered
  from (select query_id, {TOK} as t from questions) a) b)"""


@query("T3_query_terms", f"with {X.QUESTIONS_SQL}, {QT} select query_id, count(*) as n, string_agg(term, '|' order by term) as terms from qt group by 1")
def _qterms(spark, sf):
    q = X.questions(spark, sf).select("query_id", query_terms(F.col("q")).alias("t"))
    return q.select("query_id", F.size("t").alias("n"), F.array_join(F.array_sort("t"), "|").alias("terms"))


SPARSE = f"""{POST}, dl as (select chunk_id, len({DOC_TOK}) as length from chunks), tot as (select count(*) as n, avg(length) as avgdl from dl),
dfs as (select term, count(*) as df from post group by 1),
sp as (select query_id, chunk_id, round(sum(ln(1+(n-df+0.5)/(df+0.5)) * tf*2.2/(tf+1.2*(0.25+0.75*length/avgdl))), 8) as sparse_score
  from qt join post using(term) join dfs using(term) join dl using(chunk_id) cross join tot group by 1,2),
spr as (select *, row_number() over (partition by query_id order by sparse_score desc, chunk_id) as rank_s from sp)"""
DENSE = """dn as (select query_id, chunk_id, round(list_cosine_similarity(embedding::double[], qvec::double[]), 8) as dense_score from chunks cross join questions where embedding is not null and qvec is not null),
dnr as (select *, row_number() over (partition by query_id order by dense_score desc, chunk_id) as rank_d from dn)"""
FUSE = """fused as (select *, row_number() over (partition by query_id order by rrf desc, chunk_id) as rank from (
  select coalesce(d.query_id, s.query_id) as query_id, coalesce(d.chunk_id, s.chunk_id) as chunk_id, coalesce(dense_score,0) as dense_score, coalesce(sparse_score,0) as sparse_score,
    round(coalesce(1.0::double/(60+rank_d),0)+coalesce(1.0::double/(60+rank_s),0),10) as rrf
  from (select * from dnr where rank_d<=200) d full join (select * from spr where rank_s<=200) s on d.query_id=s.query_id and d.chunk_id=s.chunk_id) z)"""
TOPK = """ret as (select query_id, chunk_id, source, dense_score, sparse_score, rrf, rank, row_number() over (partition by query_id order by rank) as place from (
  select f.*, source, row_number() over (partition by query_id, source order by rank) as rs from fused f join chunks using(chunk_id) where rank<=48 and doc_status is distinct from 'superseded') z where rs<=3)"""


def all_sql(chunks_sql: str = X.CHUNKS_SQL) -> str:
    return f"with {chunks_sql}, {X.QUESTIONS_SQL}, {QT}, {SPARSE}, {DENSE}, {FUSE}, {TOPK} "


@query("T4_sparse_scores", f"with {X.CHUNKS_SQL}, {X.QUESTIONS_SQL}, {QT}, {SPARSE} select query_id, chunk_id, rank_s, sparse_score from spr where rank_s<=200")
def _sparse(spark, sf):
    return R.sparse_scores(X.text_indexed(spark, sf), X.questions(spark, sf))


@query("T5_dense_scores", f"with {X.CHUNKS_SQL}, {X.QUESTIONS_SQL}, {DENSE} select query_id, chunk_id, rank_d, dense_score from dnr where rank_d<=200")
def _dense(spark, sf):
    return R.dense_scores(X.vector_indexed(spark, sf), X.questions(spark, sf))


@query("T5_dense_probed")
def _probed(spark, sf):
    """From as many cells as recall measured at build time asks for."""
    index = V.build(X.chunks(spark, sf), f"{sf}-chunks")
    return R.dense_scores(index, X.questions(spark, sf), probes=index.probes)


def _fused(spark, sf):
    q, index = X.questions(spark, sf), X.indexes(spark, sf)
    return X.chunk_texts(spark, sf), R.fuse(R.dense_scores(index["vectors"], q), R.sparse_scores(index["texts"], q))


@query("T6_rank_fusion", all_sql() + "select query_id, chunk_id, rank, rrf from fused where rank<=48")
def _fuse(spark, sf):
    return _fused(spark, sf)[1].select("query_id", "chunk_id", "rank", "rrf")


def _rounded(d):
    return d.select("query_id", "chunk_id", "source", "place", "dense_score", "sparse_score", "rrf")


_RET = "select query_id, chunk_id, source, place, dense_score, sparse_score, rrf from ret where place<=8"


@query("T7_diversity", all_sql() + _RET)
def _hybrid(spark, sf):
    return _rounded(R.hybrid(X.chunk_texts(spark, sf), X.questions(spark, sf), **X.indexes(spark, sf)))


@query("T8_category_filter", all_sql(X.CHUNKS_SQL.replace("on doc_id=vec_id)", "on doc_id=vec_id where lang in ('en','fr'))")) + _RET)
def _category(spark, sf):
    return _rounded(R.hybrid(X.chunks(spark, sf), X.questions(spark, sf), categories=["en", "fr"]))


@query("F3_superseded", all_sql() + "select query_id, string_agg(distinct source, ',' order by source) as dropped, count(*) as n_chunks from fused join chunks using(chunk_id) where rank<=48 and doc_status='superseded' group by 1")
def _dropped(spark, sf):
    c, f = _fused(spark, sf)
    return R.dropped_superseded(f, c)


@query("T9_health", all_sql() + """select query_id, count(*) as n, max(rrf) as top_rrf, max(dense_score) as top_dense, count(distinct source) as distinct_sources,
  count(*) filter (where sparse_score>0) as sparse_contributing, count(*) filter (where dense_score>0) as dense_contributing from ret where place<=8 group by 1""")
def _health(spark, sf):
    h = R.health(R.hybrid(X.chunk_texts(spark, sf), X.questions(spark, sf), **X.indexes(spark, sf)))
    return h.select("query_id", "n", "top_rrf", "top_dense", "distinct_sources", "sparse_contributing", "dense_contributing")


@query("T10_source_layout", f"with {X.CHUNKS_SQL} select source, chunk_id, cast(coalesce(sum(length(text)+1) over (partition by source order by chunk_id rows between unbounded preceding and 1 preceding),0) as bigint) as start, length(text) as length from chunks")
def _layout(spark, sf):
    return R.source_layout(X.chunk_texts(spark, sf))
