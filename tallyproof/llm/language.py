"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are runs of two to five bytes of the lower-cased letters, not across words, word ends marked by a blank. Their
embeddings and the softmax are trained together by stochastic gradient descent in numpy on a bounded sample of labelled
documents, whole texts and short stretches of them. A temperature is fitted on documents kept back, and the probability below
which a prediction is rejected is the lowest that keeps the accepted ones as accurate as asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyproof.llm.common import SLOTS, small_batches

#: Expected number of labelled documents of each language that are learnt from; one in ten of them only calibrates.
ROWS_PER_LANGUAGE = 1_000
BITS, DIM, EPOCHS, RATE, BATCH = 16, 16, 4, 0.6, 32
#: Each training text also gives so many stretches of so many characters.
STRETCHES, STRETCH_CHARS = 4, 48
ACCURACY = 0.99
PIECE_BYTES = 1 << 20
LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))


def subwords(text: str, bits: int = BITS):
    """Bucket numbers of all subwords of a text, in parts of bounded size."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(LETTERS) + b" ", np.uint8)
    for low in range(0, len(raw), PIECE_BYTES):
        x = raw[low:low + PIECE_BYTES + 4]
        blank = x == 32
        keep = ~(blank & np.concatenate([[False], blank[:-1]]))
        x, blank = x[keep].astype(np.uint32), blank[keep]
        h, inside, out = x, np.ones(len(x), bool), []
        for n in range(2, 6):
            if len(x) < n:
                break
            h = h[:len(x) - n + 1] * np.uint32(16777619) ^ x[n - 1:]
            inside = inside[:len(x) - n + 1]
            if n > 2:
                inside = inside & ~blank[n - 2:len(x) - 1]
            out.append((h[inside] * np.uint32(2654435769)) >> np.uint32(32 - bits))
        yield np.concatenate(out) if out else np.zeros(0, np.uint32)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def examples(docs: DataFrame, rows: int) -> DataFrame:
    """``(lang, calibrates, ids, counts)`` of a bounded sample of the labelled documents outside the held-out part."""
    able = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    known = docs.select("doc_id", "lang", "text").where(able).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))
    sizes = known.groupBy("lang").count()
    picked = known.join(F.broadcast(sizes), "lang").where(F.col("h") < float(rows) / F.col("count") * SLOTS)

    def run(batches):
        for batch in batches:
            out = []
            for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text"))):
                step = max(1, len(text) // STRETCHES)
                for part in [text, *(text[i:i + STRETCH_CHARS] for i in range(0, len(text), step))][:STRETCHES + 1]:
                    ids, counts = np.unique(np.concatenate(list(subwords(part))), return_counts=True)
                    if len(ids):
                        out.append((lang, h % 10 == 0, h, ids.astype(np.int32), counts.astype(np.int32)))
            lang, cal, h, ids, counts = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(cal, pa.bool_()), pa.array(h, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                                             ["lang", "calibrates", "h", "ids", "counts"])

    return picked.select("lang", "h", "text").mapInArrow(run, "lang string, calibrates boolean, h bigint, ids array<int>, counts array<int>")


def train(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, accuracy: float = ACCURACY, seed: int = 7) -> dict | None:
    """Languages, a table of scores by bucket (embeddings times softmax weights), bias, temperature and rejection level."""
    found = examples(docs, rows).toArrow()
    if not found.num_rows:
        return None
    order = np.lexsort((found["ids"].combine_chunks().value_lengths().to_numpy(), found["h"].to_numpy()))
    langs = sorted(set(found["lang"].to_pylist()))
    y_all = np.array([langs.index(v) for v in found["lang"].to_pylist()])
    calibrates = np.array(found["calibrates"].to_pylist())
    ids = found["ids"].combine_chunks()
    starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    counts = found["counts"].combine_chunks().values.to_numpy().astype(np.float32)
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (1 << BITS, DIM)).astype(np.float32) / DIM
    w, b = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    fits = order[~calibrates[order]] if (~calibrates).any() else order
    weight = len(fits) / (len(langs) * np.maximum(np.bincount(y_all[fits], minlength=len(langs)), 1))

    def gather(rows):
        size = starts[rows + 1] - starts[rows]
        at = np.arange(size.sum()) + np.repeat(starts[rows] - (np.cumsum(size) - size), size)
        owner = np.repeat(np.arange(len(rows)), size)
        share = counts[at] / np.bincount(owner, counts[at], len(rows))[owner]
        return flat[at], owner, share.astype(np.float32), np.cumsum(size) - size

    def softmax(z):
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    steps, done = EPOCHS * -(-len(fits) // BATCH), 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(fits)
        for low in range(0, len(mixed), BATCH):
            rows_ = mixed[low:low + BATCH]
            bucket, owner, share, first = gather(rows_)
            h = np.add.reduceat(e[bucket] * share[:, None], first)
            d = softmax(h @ w + b)
            d[np.arange(len(rows_)), y_all[rows_]] -= 1
            d *= weight[y_all[rows_]][:, None].astype(np.float32)
            rate = RATE * (1 - done / steps)
            back = (d @ w.T)[owner] * share[:, None]
            w -= rate / len(rows_) * BATCH ** 0.5 * (h.T @ d)
            b -= rate / len(rows_) * d.sum(0)
            np.subtract.at(e, bucket, rate * back)
            done += 1
    table = e @ w
    checks = order[calibrates[order]] if calibrates.any() else fits
    z = np.concatenate([np.add.reduceat(table[bucket] * share[:, None], first) + b for bucket, _, share, first in
                        (gather(checks[low:low + 512]) for low in range(0, len(checks), 512))])
    y = y_all[checks]
    heats = np.geomspace(0.05, 20, 60)
    heat = min(heats, key=lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean())
    p = softmax(z / heat)
    top, good = p.max(1), p.argmax(1) == y
    by = np.argsort(-top)
    enough = np.flatnonzero(np.cumsum(good[by]) / np.arange(1, len(by) + 1) >= accuracy)
    level = float(top[by[enough[-1]]]) if len(enough) else 1.0
    return {"langs": langs, "table": (table / heat).astype(np.float32), "bias": (b / heat).astype(np.float64), "level": level}


def identify(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``, one row per row of ``docs``, from the whole text alone.

    ``score`` is the calibrated probability of ``lang_pred``; ``rejected`` marks scores below the calibrated level. A
    text that is null or has no letter gets ``und``, score 0, rejected; so does every text if nothing is labelled. Learnt from are texts with a
    language whose crc32 of the id as text is not 2 modulo 4; rows without id are not learnt from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(train(base, rows))  # bounded: buckets times languages

    def run(batches):
        m = model.value
        for batch in batches:
            out = []
            for letter, text in zip(batch.column("letter").to_pylist(), batch.column("text")):
                if not letter or m is None:
                    out.append(("und", 0.0, True))
                    continue
                total, n = np.zeros(len(m["langs"])), 0
                for ids in subwords(text.as_py()):
                    total += m["table"][ids].sum(0, dtype=np.float64)
                    n += len(ids)
                z = total / max(n, 1) + m["bias"]
                p = np.exp(z - z.max())
                best = int(p.argmax())
                score = float(p[best] / p.sum())
                out.append((m["langs"][best], score, score < m["level"]))
            pred, score, rejected = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                                             ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return base.select("doc_id", held_out().alias("held_out"), letter.alias("letter"), "text").mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
