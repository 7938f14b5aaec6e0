"""Quality classifier by hierarchical empirical Bayes.

Two questions are answered for each document: is it junk, is it toxic. A linear classifier over words, word beginnings and
style, fitted on a bounded labelled sample, gives the evidence as a log Bayes factor. Hosts and the paths below
them get a rate each by grouped sums over all documents; sparse ones are shrunk, a path toward its host and a host
toward the global rate, as strongly as the spread of the rates says. A document's posterior adds its evidence to the
rate of its path, its own share taken out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyproof.llm.common import sample, small_batches, stored

#: At most so many labelled documents of each class fit the classifier.
ROWS_PER_CLASS = 2_000
#: A feature is used if its log odds differ by so many standard errors.
LEAST_Z = 3.0
REJECT_AT = 0.5
CACHE_WORDS = 200_000
#: Lines shorter than this have no style of their own.
LINE_BYTES = 40
HEADS = ("junk", "toxic")
LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))
UPPER, LOWER, MARKS, BARS, DIGITS = (bytes(c for c in range(128) if f(chr(c))) for f in (
    str.isupper, str.islower, lambda c: c in "!#$%&*@^~=<>{}[]\\/_+`", lambda c: c == "|", str.isdigit))


def word_features(word: bytes) -> list[int]:
    from xxhash import xxh32_intdigest

    return [xxh32_intdigest(word, 1) >> 1, *(xxh32_intdigest(word[:k], k) >> 1 for k in (4, 5, 6) if len(word) >= k)]


def shares(raw: bytes, words: list[bytes], distinct: int) -> list[float]:
    n, w = max(1, len(raw)), max(1, len(words))
    return [*((n - len(raw.translate(None, c))) / n for c in (UPPER, MARKS, BARS, DIGITS)), sum(map(bytes.__eq__, words, words[1:])) / w, 1 - distinct / w]


def style_features(raw: bytes, words: list[bytes], distinct: int) -> list[int]:
    """Shares of upper case, marks, bars, digits, repeated neighbours and repeated words, each as a step on a log scale:
    of the whole text, and the largest of any line of some length."""
    whole = shares(raw, words, distinct)
    worst = [0.0] * len(whole)
    for line in raw.split(b"\n"):
        if len(line) >= LINE_BYTES:
            own = line.split()
            worst = list(map(max, worst, shares(line, own, len(set(own)))))
    steps = [max(-20, math.floor(2 * math.log2(s + 1e-4))) + 20 for s in whole + worst]
    return [2_000_000_000 + 100 * i + s for i, s in enumerate(steps)]


def split(text: str | None) -> tuple[bytes, list[bytes]]:
    raw = (text or "").encode("utf-8", "replace")
    return raw, (text or "").lower().encode("utf-8", "replace").translate(LETTERS).split()


def fit(ids: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``(features, weights, bias)`` of a logistic regression with both classes weighted alike, by gradient descent over
    the features whose presence tells the classes apart. Without both classes it knows nothing."""
    rows = np.repeat(np.arange(len(y)), np.diff(starts))
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    known, inverse = np.unique(ids, return_inverse=True)
    a = np.bincount(inverse, y[rows], len(known)) + 0.5
    b = np.bincount(inverse, 1 - y[rows], len(known)) + 0.5
    c, d = n1 - a + 1, n0 - b + 1
    z = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    chosen = z >= LEAST_Z
    place = np.cumsum(chosen) - 1
    use = chosen[inverse]
    col, row = place[inverse[use]], rows[use]
    m = int(chosen.sum())
    share = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    w, bias, g2, gb2 = np.zeros(m), 0.0, np.full(m, 1e-8), 1e-8
    for _ in range(800):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)) + bias, -30, 30)))
        err = share * (p - y)
        g, gb = np.bincount(col, err[row], m) + 1e-5 * w, err.sum()
        g2, gb2 = g2 + g * g, gb2 + gb * gb
        w, bias = w - 0.3 * g / np.sqrt(g2), bias - 0.3 * gb / np.sqrt(gb2)
    return known[chosen], w, float(bias)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> dict:
    """The model: weights by feature for both heads, and the labelled rates. Labels may be null, missing or repeated (the
    first by id and values counts)."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (1 - F.col("quality").cast("int")).alias("junk"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null")
    rates = marked.agg(*[F.avg(h).alias(h) for h in HEADS]).first()
    classes = [(F.coalesce("junk", F.lit(0)) == 0) & (F.coalesce("toxic", F.lit(0)) == 0), F.col("junk") == 1, F.col("toxic") == 1]
    picked = reduce(DataFrame.union, [sample(marked.where(c), rows_per_class) for c in classes])
    picked = picked.groupBy("doc_id").agg(F.min(F.struct("junk", "toxic")).alias("y")).select("doc_id", "y.junk", "y.toxic")
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                raw, words = split(text.as_py())
                distinct = set(words)
                out.append(sorted({f for word in distinct for f in word_features(word)} | set(style_features(raw, words, len(distinct)))))
            yield pa.RecordBatch.from_arrays([batch.column("junk"), batch.column("toxic"), pa.array(out, pa.list_(pa.int32()))], ["junk", "toxic", "features"])

    got = known.select("text", "junk", "toxic").mapInArrow(run, "junk int, toxic int, features array<int>").toArrow()
    features = got["features"].combine_chunks()
    lists = features.chunk(0) if isinstance(features, pa.ChunkedArray) and features.num_chunks else features
    if not got.num_rows:
        ids, starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
    else:
        ids, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
    weights, bias = {}, [0.0, 0.0]
    for k, head in enumerate(HEADS):
        y = np.array(got[head].to_pylist(), float)
        valid = ~np.isnan(y)
        keep = np.repeat(valid, np.diff(starts))
        own = np.concatenate([[0], np.cumsum(np.diff(starts)[valid])])
        chosen, w, bias[k] = fit(ids[keep], own, y[valid])
        for f, value in zip(chosen.tolist(), w.tolist()):
            weights.setdefault(f, [0.0, 0.0])[k] = value
    return {"weights": weights, "bias": bias, "rates": [float(np.clip(rates[h] if rates[h] is not None else 0.1, 0.001, 0.999)) for h in HEADS]}


def evidence(docs: DataFrame, model: dict, host: Column, path: Column) -> DataFrame:
    """``(doc_id, row, host, path, junk, toxic)``: the log Bayes factors of each document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        weights, bias = shared.value["weights"], shared.value["bias"]

        class Known(dict):
            def __missing__(self, word):
                if len(self) >= CACHE_WORDS:
                    self.clear()
                self[word] = found = tuple(f for f in word_features(word) if f in weights)
                return found

        known = Known()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                raw, words = split(text.as_py())
                distinct = set(words)
                present = {f for f in style_features(raw, words, len(distinct)) if f in weights}
                for found in map(known.__getitem__, distinct):
                    if found:
                        present.update(found)
                out.append([bias[k] + sum(weights[f][k] for f in present) for k in (0, 1)])
            junk, toxic = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "host", "path")), pa.array(junk, pa.float64()), pa.array(toxic, pa.float64())],
                                             ["doc_id", "row", "host", "path", *HEADS])

    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), text.alias("text"),
                       F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    return base.mapInArrow(run, "doc_id bigint, row bigint, host string, path string, junk double, toxic double")


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def bounded(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))


def strength(rates: DataFrame, rate: str, toward: Column, n: str) -> float:
    """Pseudo-counts of the prior, by moments: how little the rates of well-filled groups spread around what they shrink toward."""
    r = rates.where(F.col(n) >= 2).agg(
        F.sum(F.col(n) * toward * (1 - toward)).alias("binomial"), F.sum(F.col(n) * (F.col(rate) - toward) ** 2).alias("seen"),
        F.sum(toward * (1 - toward)).alias("noise"), F.sum(n).alias("n")).first()
    if not r.n or not r.binomial:
        return 10.0
    spread = max((r.seen - r.noise) / r.n, 1e-9)
    return float(np.clip(r.binomial / r.n / spread - 1, 1.0, 1e4))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, reject_at: float = REJECT_AT,
             rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """``(doc_id, row, host, path, junk_evidence, toxic_evidence, host_junk, host_toxic, path_junk, path_toxic, p_junk,
    p_toxic, kept)``, one row per row of ``docs``; ``row`` hashes the text.

    Kept: neither posterior reaches ``reject_at``. Hosts default to ``source``, paths to ``source`` and ``lang``; null
    counts as the empty name. A null or empty text has only style evidence. Without usable labels the evidence is 0 and everything is
    kept at the default rate. A host may hold any share of the rows: its sums are combined in the tasks.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", "source", "lang") if path is None else path
    model = train(docs, labels, rows_per_class)
    seen = stored(evidence(docs, model, host, path), "quality-evidence")
    soft = seen
    for head, rate in zip(HEADS, model["rates"]):
        soft = soft.withColumn(f"soft_{head}", 1 / (1 + F.exp(-(F.col(head) + float(np.log(rate / (1 - rate)))))))
    sites = stored(soft.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(f"soft_{h}").alias(f"sum_{h}") for h in HEADS]), "quality-sites")
    hosts = stored(sites.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"sum_{h}").alias(f"host_sum_{h}") for h in HEADS]), "quality-hosts")
    total = hosts.agg(F.sum("host_n").alias("n"), *[F.sum(f"host_sum_{h}").alias(h) for h in HEADS]).first()
    for head in HEADS:
        rate = float(np.clip((total[head] or 0.0) / total.n if total.n else 0.1, 1e-4, 1 - 1e-4))
        hosts = hosts.withColumn(f"raw_{head}", F.col(f"host_sum_{head}") / F.col("host_n"))
        m = strength(hosts, f"raw_{head}", F.lit(rate), "host_n")
        hosts = hosts.withColumn(f"host_{head}", bounded((F.col(f"host_sum_{head}") + m * rate) / (F.col("host_n") + m)))
    sites = sites.join(hosts.select("host", *[f"host_{h}" for h in HEADS]).hint("merge"), "host")
    drawn = {}
    for head in HEADS:
        sites = sites.withColumn(f"raw_{head}", F.col(f"sum_{head}") / F.col("n"))
        drawn[head] = strength(sites, f"raw_{head}", F.col(f"host_{head}"), "n")
    both = soft.join(sites.select("host", "path", "n", *[f"{k}_{h}" for h in HEADS for k in ("sum", "host")]).hint("merge"), ["host", "path"])
    for head in HEADS:
        m = drawn[head]
        rest = (F.greatest(F.col(f"sum_{head}") - F.col(f"soft_{head}"), F.lit(0.0)) + m * F.col(f"host_{head}")) / (F.col("n") - 1 + m)
        both = both.withColumn(f"path_{head}", bounded(rest))
        both = both.withColumn(f"p_{head}", 1 / (1 + F.exp(-(F.col(head) + logit(F.col(f"path_{head}"))))))
    kept = reduce(lambda a, b: a & b, [F.col(f"p_{h}") < reject_at for h in HEADS])
    return both.select("doc_id", "row", "host", "path", *[F.col(h).alias(f"{h}_evidence") for h in HEADS],
                       *[f"{k}_{h}" for k in ("host", "path", "p") for h in HEADS], kept.alias("kept"))
