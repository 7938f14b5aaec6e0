"""Packing of documents into token sequences of fixed room by best-two-fit.

A bin is filled greedily with the largest piece that fits. Then its smallest piece is taken out again if two unpacked
pieces fill the larger gap more tightly. Whether pieces fit depends on their lengths alone, so the bins are planned on
the histogram of lengths: as many counters as a sequence has tokens, whatever the number of documents. A plan is a list
of patterns (which lengths, how often each) and how many sequences follow each pattern. Pieces find their
place by their rank among those of their length, which is counted in blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyproof.functions.ordered import number_rows
from tallyproof.llm.common import id_and_text, small_batches, stored
from tallyproof.llm.tokens import encoder

ROOM = 2048
#: Ranks are counted in blocks of about so many pieces.
BLOCK_ROWS = 50_000


def cut_documents(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each document's ids and ``end_id``, cut only where longer
    than ``room``. A null or empty text is the end id alone."""
    small_batches(docs.sparkSession)

    def run(batches):
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, blobs = [], []
            flat, bounds = encode(batch.column(1))
            flat, bounds = memoryview(flat.tobytes()), (4 * bounds).tolist()
            for doc_id, low, high in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                ids = b"".join((flat[low:high], end))
                for piece, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at:at + 4 * room]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        blobs.append(part)
            cols = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(blobs, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return id_and_text(docs).mapInArrow(run, schema)


def plan(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(number of sequences, [(length, uses in each)])`` that places exactly ``counts[length]`` pieces of each length."""
    left = np.zeros(room + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    axis, out = np.arange(room + 1), []
    while True:
        nearest = np.maximum.accumulate(np.where(left > 0, axis, 0))
        if not nearest[room]:
            return out
        free = left.copy()
        bin_, gap = [], room
        while gap:
            at = int(nearest[gap])
            while at and not free[at]:
                at = int(nearest[at - 1])
            if not at:
                break
            n = min(gap // at, int(free[at]))
            bin_ += [at] * n
            free[at] -= n
            gap -= at * n
        if gap and len(bin_) > 1:
            smallest, wider = bin_[-1], gap + bin_[-1]
            below = np.maximum.accumulate(np.where(free > 0, axis, 0))
            first = axis[1:wider + 1][free[1:wider + 1] > 0]
            if len(first):
                second = np.minimum(below[wider - first], first)
                alone = (second == first) & (free[first] < 2)
                second = np.where(alone, below[first - 1], second)
                total = np.where(second > 0, first + second, 0)
                best = int(total.argmax())
                if total[best] > smallest:
                    bin_[-1:] = [int(first[best]), int(second[best])]
        uses = {}
        for at in bin_:
            uses[at] = uses.get(at, 0) + 1
        times = min(int(left[at]) // n for at, n in uses.items())
        for at, n in uses.items():
            left[at] -= times * n
        out.append((times, sorted(uses.items(), reverse=True)))


def pack(pieces: DataFrame, room: int = ROOM, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``(doc_id, piece, length)``.

    Sequences are gapless from offset 0 and hold at most ``room`` tokens. Pieces must be no longer than ``room``.
    Ranks follow a hash of the id, so ids may come in any order and may be null or repeated; a third of all pieces
    may have one length. What reaches the driver is the histogram, at most ``room`` rows. An empty table gives none.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    runs, sequence, taken = [], 0, dict.fromkeys(counts, 0)
    for times, uses in plan(counts, room):
        at = 0
        for length, n in uses:
            runs.append((length, taken[length], n, sequence, at))
            taken[length] += times * n
            at += length * n
        sequence += times
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(runs)  # at most a few rows for each length and pattern, both bounded by room
    blocks = max(1, sum(counts.values()) // block_rows)
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks))
    ranked = number_rows(pieces.withColumn("_block", block), ["length"], {"b": F.col("_block")}, ["_block", "doc_id", "piece"], "_rank")
    names = [c for c in ranked.columns if c not in ("_block", "_rank")]

    def place(batches):
        runs = shared.value
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy() - 1
            row = runs[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(length) else runs[:0]
            inside = rank - row[:, 1]
            cols = [batch.column(c) for c in names] + [pa.array(row[:, 3] + inside // np.maximum(row[:, 2], 1)),
                                                       pa.array(row[:, 4] + inside % np.maximum(row[:, 2], 1) * length)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_block", "_rank").schema.fields)
    return ranked.drop("_block").mapInArrow(place, schema + ", sequence_id bigint, offset bigint")


def packed(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for all documents."""
    return pack(stored(cut_documents(docs, tokenizer, room), "pieces"), room)


def sequences(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """``(sequence_id, n_tokens, ids)`` with the ids of each sequence in order; a sequence has at most ``room`` ids."""
    placed = pack(stored(cut_documents(docs, tokenizer, room, with_ids=True), "pieces-ids"), room)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
