"""Inverted file over vectors: cells of a k-means, vectors in blocks by cell, exact cosine within the cells that are probed.

Centres are fitted on a bounded sample; every vector is assigned. A question looks into the cells with the nearest
centres. With ``probes=None`` it looks into all of them and the ranks are exact; a block that lies too far from the
question to enter its pool is skipped. The number of probes is chosen when the index is built, by recall measured against the exact ranks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import first_per_key
from ..session import written

#: Rows that fit the centres, the most centres (their matrix goes to every task), vectors of a block, questions of a block.
SAMPLE_ROWS, MOST_CELLS, BLOCK, ASKED = 100_000, 4096, 512, 256
#: Vectors that stand in for questions when recall is measured, and the recall asked for.
TRIALS, RECALL = 200, 0.9


@dataclass
class VectorIndex:
    """``blocks``: cell, least (lowest cosine to the centre), ids, sources, vectors. ``vectors``: chunk_id, source, embedding."""

    blocks: DataFrame
    vectors: DataFrame
    centres: np.ndarray
    probes: int
    recall: dict[int, float]


_BUILT: dict[tuple[str, str], VectorIndex] = {}


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)  # a zero vector has cosine 0


def _centres(vectors: DataFrame, n: int, cells: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    slots = 1 << 30
    drawn = vectors.where(F.pmod(F.xxhash64("chunk_id"), F.lit(slots)) < int(share * slots) + (share == 1.0))
    x = F.col("embedding").cast("array<double>")
    drawn = drawn.where(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) > 0).select(array_to_vector(x).alias("features"))
    if not n:
        return np.zeros((0, 1))
    if cells < 2 or drawn.limit(cells).count() < cells:
        return np.zeros((1, len(vectors.first().embedding)))
    model = KMeans(k=cells, maxIter=8, initSteps=2, seed=7, distanceMeasure="cosine").fit(drawn.repartition(max(1, min(64, n // 5_000))))
    return _unit(np.array(model.clusterCenters()))


def build(chunks: DataFrame, scope: str | None = None, cells: int | None = None, measure: bool = True) -> VectorIndex:
    """Build and store the index; with ``scope``, once per application and scope. ``measure`` chooses the probes."""
    spark, scope = chunks.sparkSession, scope or uuid.uuid4().hex
    key = spark.sparkContext.applicationId, scope
    if key in _BUILT:
        if measure and not _BUILT[key].recall:
            _BUILT[key] = measured(_BUILT[key])
        return _BUILT[key]
    vectors = written(spark, scope, "vector-index-vectors", lambda: chunks.where("embedding is not null").select("chunk_id", "source", "embedding"))
    n = vectors.count()
    centres = _centres(vectors, n, min(MOST_CELLS, cells or max(1, math.isqrt(n))))
    shared = spark.sparkContext.broadcast(centres)  # bounded by MOST_CELLS

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = _unit(np.vstack(b.embedding.to_numpy()).astype(np.float64)) @ shared.value.T
                b["cell"] = near.argmax(1)
                b["near"] = near[np.arange(len(b)), b.cell]
                yield b

    def blocks() -> DataFrame:
        names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
        placed = written(spark, scope, "vector-index-cells", lambda: vectors.mapInPandas(assign, names + ", cell int, near double"))
        size = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("parts"))
        parted = placed.join(F.broadcast(size), "cell").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")))  # a row for each cell
        return parted.groupBy("cell", "part").agg(F.min("near").alias("least"), F.collect_list("chunk_id").alias("ids"), F.collect_list("embedding").alias("vectors"))

    index = VectorIndex(written(spark, scope, "vector-index-blocks", blocks, ["cell"], long_rows=True), vectors, centres, len(centres), {})
    _BUILT[key] = measured(index) if measure else index
    return _BUILT[key]


def search(index: VectorIndex, questions: DataFrame, pool: int, probes: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``(query_id, chunk_id, dense_score, rank_d)``: the ``pool`` chunks of highest cosine per question among the cells
    looked into, ties to the smaller id. ``sources`` (query_id, source) limits a question to the documents it names; such a question is answered exactly.
    """
    spark = questions.sparkSession
    q = questions.where("qvec is not null").select("query_id", "qvec")
    limited = None
    if sources is not None:
        named = sources.select("query_id", "source").distinct()
        limited, q = q.join(named, "query_id"), q.join(named.select("query_id").distinct(), "query_id", "left_anti")
    key, chunk = dict(questions.dtypes)["query_id"], dict(index.vectors.dtypes)["chunk_id"]
    shared = spark.sparkContext.broadcast(index.centres)
    take = len(index.centres) if probes is None else min(probes, len(index.centres))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and take:
                near = _unit(np.vstack(b.qvec.to_numpy()).astype(np.float64)) @ shared.value.T
                cells = np.argsort(-near, axis=1, kind="stable")[:, :take]
                row = np.repeat(np.arange(len(b)), take)
                yield pd.DataFrame({"query_id": b.query_id.to_numpy()[row], "qvec": b.qvec.to_numpy()[row], "cell": cells.ravel(), "to_cell": np.take_along_axis(near, cells, 1).ravel()})

    asked = q.mapInPandas(nearest, f"query_id {key}, qvec array<double>, cell int, to_cell double")
    asked = asked.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-q.count() // ASKED)))).alias("part")).agg(F.collect_list(F.struct("query_id", "qvec", "to_cell")).alias("asked"))
    pairs = index.blocks.select("cell", "least", "ids", "vectors").join(asked.select("cell", "asked"), "cell").select("least", "ids", "vectors", "asked")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for b in batches:
            for least, ids, vectors, asked in zip(b.least, b.ids, b.vectors, b.asked):
                width = math.acos(max(-1.0, min(1.0, least)))
                live = []
                for a in asked:  # the least angle between the question and a vector of the block
                    angle = max(0.0, math.acos(max(-1.0, min(1.0, a["to_cell"]))) - width)
                    have = best.get(a["query_id"])
                    if have is None or len(have[0]) < pool or math.cos(angle) + 1e-7 >= have[1][-1]:
                        live.append(a)
                if not live:
                    continue
                ids = np.asarray(ids)
                s = np.round(_unit(np.vstack([a["qvec"] for a in live]).astype(np.float64)) @ _unit(np.vstack(vectors).astype(np.float64)).T, 8)
                for a, row in zip(live, s):
                    k, v = best.get(a["query_id"], (ids[:0], row[:0]))
                    k, v = np.concatenate([k, ids]), np.concatenate([v, row])
                    at = np.lexsort((k, -v))[:pool]
                    best[a["query_id"]] = k[at], v[at]
        for query, (k, v) in best.items():
            yield pd.DataFrame({"query_id": query, "chunk_id": k, "dense_score": v})

    found = pairs.mapInPandas(score, f"query_id {key}, chunk_id {chunk}, dense_score double")
    if limited is not None:
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
        both = limited.join(index.vectors, "source")
        norm = F.sqrt(dot("qvec", "qvec")) * F.sqrt(dot("embedding", "embedding"))
        found = found.unionByName(both.select("query_id", "chunk_id", F.when(norm > 0, F.round(dot("qvec", "embedding") / norm, 8)).otherwise(0.0).alias("dense_score")))
    return first_per_key(found, ["query_id"], [F.desc("dense_score"), "chunk_id"], pool, rank="rank_d")


def recall(index: VectorIndex, questions: DataFrame, pool: int, probes: int) -> float:
    """The share of the exact pools that ``probes`` cells bring."""
    exact = search(index, questions, pool).select("query_id", "chunk_id")
    got = search(index, questions, pool, probes).select("query_id", "chunk_id")
    return exact.join(got, ["query_id", "chunk_id"]).count() / max(1, exact.count())


def measured(index: VectorIndex, pool: int = 10, least: float = RECALL) -> VectorIndex:
    """The index with the fewest probes (a power of two) that reach the recall; questions are some of its own vectors."""
    share, cells = min(1.0, TRIALS / max(1, index.vectors.count())), len(index.centres)
    slots = 1 << 30
    own = index.vectors.where(F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(slots)) < int(share * slots) + (share == 1.0))
    own = own.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))
    found, probes = {}, 1
    while probes < cells:
        found[probes] = recall(index, own, pool, probes)
        if found[probes] >= least:
            break
        probes *= 2
    probes = min(probes, cells)
    return replace(index, probes=probes, recall=found if probes < cells else {**found, cells: 1.0})
