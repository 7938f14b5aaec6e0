"""Hybrid retrieval for many questions at once: term scores, vector scores, rank fusion, diversity.

``chunks``: chunk_id, source, category, doc_status, text, embedding (NULL where there is none).
``questions``: query_id, q, qvec.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import SMALL_ROWS, small
from ..functions.ordered import chain, first_per_key, seq_block
from ..functions.text import tokens
from . import text_index, vector_index
from .text_index import TextIndex, postings  # noqa: F401
from .vector_index import VectorIndex

RRF_K, POOL, TOP_K, PER_SOURCE, CUT = 60, 200, 8, 3, 6


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.size(tokens(F.concat_ws(" ", "category", "text"))).cast("bigint").alias("length"))


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def sparse_scores(chunks: DataFrame | TextIndex, questions: DataFrame, pool: int = POOL, sources: DataFrame | None = None) -> DataFrame:
    """The ``pool`` chunks of highest BM25 score per question, exact, over whole texts, from an index or chunks to be indexed."""
    index = chunks if isinstance(chunks, TextIndex) else text_index.build(chunks)
    return text_index.search(index, questions, pool, sources)


def dense_scores(chunks: DataFrame | VectorIndex, questions: DataFrame, pool: int = POOL, sources: DataFrame | None = None, probes: int | None = None) -> DataFrame:
    """The ``pool`` chunks of highest cosine per question, exact unless ``probes`` limits the cells looked into."""
    index = chunks if isinstance(chunks, VectorIndex) else vector_index.build(chunks, measure=False)
    return vector_index.search(index, questions, pool, probes, sources)


def fuse(dense: DataFrame, sparse: DataFrame, cut: int = CUT * TOP_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked arms, in a total order, cut before the later filters."""
    rr = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)), F.lit(0.0))
    d = dense.join(sparse, ["query_id", "chunk_id"], "full_outer").select(
        "query_id", "chunk_id", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"),
        F.round(rr("rank_d") + rr("rank_s"), 10).alias("rrf"))
    return first_per_key(d, ["query_id"], [F.desc("rrf"), "chunk_id"], cut, rank="rank")


def _with_chunks(fused: DataFrame, chunks: DataFrame, questions: DataFrame | None) -> DataFrame:
    """Fused ranks with columns of their chunks. A question has at most some dozens of ranks, so a checked number of
    questions bounds the ranks; only then are they broadcast."""
    few = questions is not None and small(questions, SMALL_ROWS // (CUT * TOP_K))
    return chunks.join(F.broadcast(fused) if few else fused, "chunk_id")


def diversify(fused: DataFrame, chunks: DataFrame, questions: DataFrame | None = None, top_k: int = TOP_K, per_source: int = PER_SOURCE, include_superseded: bool = False) -> DataFrame:
    """Drop superseded chunks, keep at most ``per_source`` per source in rank order, then the first ``top_k``."""
    d = _with_chunks(fused, chunks.select("chunk_id", "source", "doc_status"), questions)
    if not include_superseded:
        d = d.where(~F.col("doc_status").eqNullSafe("superseded"))
    d = first_per_key(d, ["query_id", "source"], ["rank"], per_source)
    return first_per_key(d, ["query_id"], ["rank"], top_k, rank="place").drop("doc_status")


def dropped_superseded(fused: DataFrame, chunks: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """Sources left out for being superseded, per question."""
    d = _with_chunks(fused, chunks.where("doc_status = 'superseded'").select("chunk_id", "source"), questions)
    return d.groupBy("query_id").agg(F.array_sort(F.collect_set("source")).alias("dropped"), F.count("*").alias("n_chunks"))


def hybrid(chunks: DataFrame, questions: DataFrame, categories: list[str] | None = None, top_k: int = TOP_K, pool: int = POOL,
           per_source: int = PER_SOURCE, sources: DataFrame | None = None, texts: TextIndex | None = None, vectors: VectorIndex | None = None) -> DataFrame:
    """The whole path. ``categories`` filters before either arm scores; ``sources`` (query_id, source), where given for
    a question, limits both arms to the documents it names. ``texts`` and ``vectors`` are stored indexes of just these chunks."""
    c = chunks if categories is None else chunks.where(F.col("category").isin(categories))
    f = fuse(dense_scores(vectors or c, questions, pool, sources), sparse_scores(texts or c, questions, pool, sources), CUT * top_k)
    return diversify(f, c, questions, top_k, per_source)


def health(retrieved: DataFrame, own: Column | None = None) -> DataFrame:
    """Per-question retrieval health."""
    own = own if own is not None else F.lit(False)
    return retrieved.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("rrf").alias("top_rrf"), F.max("dense_score").alias("top_dense"),
        F.count_distinct("source").alias("distinct_sources"), F.count_if(F.col("sparse_score") > 0).alias("sparse_contributing"),
        F.count_if(F.col("dense_score") > 0).alias("dense_contributing"), F.count_if(own).alias("own_docs"), F.count_if(~own).alias("shared_docs"))


def source_layout(chunks: DataFrame, order: str = "chunk_id") -> DataFrame:
    """Where each chunk lies in the running text of its source (chunks in order, one line break between them).

    The text of a source is never joined into one value, since one source may hold a large share of all texts.
    """
    c = chunks.select("source", order, F.length("text").cast("bigint").alias("length"))
    c = chain(c, ["source"], {"range": seq_block(order)}, [order], sums={"end": F.col("length") + 1})
    return c.select("source", order, (F.col("end") - F.col("length") - 1).alias("start"), "length")
