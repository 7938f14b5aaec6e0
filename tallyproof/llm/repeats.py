"""Removal of passages that repeat: windows of words, found by a count-min prefilter and grouped exactly after it.

First pass: each block of documents sends its sketch. A window is counted by its anchor, the smallest hash among the
stretches of a few words inside it; equal windows have equal anchors at equal places, so an anchor occurs at least as
often as any window it stands for, and there are several times fewer anchors than windows. An anchor counts in one
cell of each row of the sketch. A block's sketch is the sorted list of its cells, counts of two and more being alike; slices of the
cell space are merged, and each block is told which of its cells hold two or more. Second pass: windows with such
a cell in every row are estimated as repeated, and only they are grouped, by 128 bits of word hashes cut to 96; the first of each
group is sent back to its block. Third pass: windows that were estimated as repeated and are no first
ones are removed, word by word. A sketch cell never counts too little, so no repeated window is lost; a cell shared by chance only
sends a window into the exact grouping.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyproof.llm.blocks import answers, by_block, in_blocks, staged
from tallyproof.llm.common import id_and_text, small_batches
from tallyproof.llm.words import Rolling, codes, mix, slide, split_words

WORDS, GRAM = 20, 8
#: Rows of the sketch, and their seeds (fixed values).
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
#: Cells of a row for each 6 bytes of text (about a word, or a sixth of an anchor), and cells of a slice.
SLICE_CELLS = 1 << 24
#: Candidates or anchors that a task gathers before it sends them.
SEND = 1 << 19
NO_ID = -(1 << 63)


class Windows:
    """Windows of the documents of an Arrow batch: their anchors, keys and places."""

    def __init__(self, doc_ids: pa.Array, texts: pa.Array, rolling: Rolling, n: int, gram: int):
        self.bounds, self.index, self.words = split_words(texts)
        self.ids = doc_ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        count = np.maximum(np.diff(self.bounds) - n + 1, 0)
        self.row = np.repeat(np.arange(len(count)), count)
        self.start = np.arange(len(self.row)) - np.repeat(np.cumsum(count) - count, count)
        self.at = self.bounds[self.row] + self.start
        code = codes(self.words)[self.index] if len(self.index) else np.zeros(0, np.uint64)
        self.high = rolling(code, n)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.low = (rolling(mix(code + np.uint64(1)), n)[self.at] >> np.uint64(32)).astype(np.uint32) if len(self.at) else np.zeros(0, np.uint32)
        if not len(self.at):
            self.anchor = self.anchors = np.zeros(0, np.uint64)
            return
        grams = rolling(code, gram)
        low = slide(np.minimum, grams, n - gram + 1)
        self.anchor = low[self.at]
        real = np.zeros(len(low), bool)  # a stretch across two documents is no window
        real[self.at] = True
        reach = np.where(real, low, 0)
        reach = np.concatenate([np.zeros(n - gram, np.uint64), reach, np.zeros(n - gram, np.uint64)])
        self.anchors = grams[grams == slide(np.maximum, reach, n - gram + 1)]


def cells(anchor: np.ndarray, seed: int, bits: int) -> np.ndarray:
    return mix(anchor ^ np.uint64(seed)) >> np.uint64(64 - bits)


def pack(x: np.ndarray) -> bytes:
    """An ascending array as its first value and steps in as few bytes as the largest one needs."""
    steps = np.diff(x)
    kind = np.min_scalar_type(steps.max() if len(steps) else 0).newbyteorder("<")
    return bytes([kind.itemsize]) + x[:1].astype("<u8").tobytes() + steps.astype(kind).tobytes()


def unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, f"<u{data[0]}", offset=9)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1, 1), steps.astype(np.uint64)]))


def pieces(x: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """``(slice, low, high)`` for each slice that an ascending array has values in."""
    part = x >> np.uint64(shift)
    lows = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1]) if len(x) else np.zeros(0, int)
    return list(zip(part[lows].tolist(), lows.tolist(), [*lows[1:].tolist(), len(x)])) if len(x) else []


def at_most_two(x: np.ndarray) -> np.ndarray:
    """An ascending array with at most two of each value."""
    return x[np.concatenate([np.ones(min(2, len(x)), bool), x[2:] != x[:-2]])]


def within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the ascending array ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def sketch(docs: DataFrame, n: int, gram: int, bits: int, shift: int) -> DataFrame:
    """``(block, seed, slice, cells)``: the sketches of parts of blocks."""

    def run(batches):
        rolling, held, size = Rolling(), [], 0

        def send(block):
            rows = []
            for seed, value in enumerate(SEEDS):
                found = at_most_two(np.sort(cells(np.concatenate(held), value, bits)))
                rows += [(block, seed, k, pack(found[a:b])) for k, a, b in pieces(found, shift)]
            cols = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["block", "seed", "slice", "cells"])

        now = None
        for batch in batches:
            for block, part in in_blocks(batch):
                if held and (block != now or size >= SEND):
                    yield send(now)
                    held, size = [], 0
                now = block
                found = Windows(part.column(0), part.column(1), rolling, n, gram).anchors
                held, size = [*held, found], size + len(found)
        if held:
            yield send(now)

    return docs.mapInArrow(run, "block string, seed int, slice bigint, cells binary")


def merge(sketches: DataFrame) -> DataFrame:
    """``(block, seed, slice, cells)`` with the cells of each block that count two or more over all blocks. A group is
    one slice, bounded by its number of cells and twice the number of blocks."""

    def run(table: pa.Table) -> pa.Table:
        lists = [unpack(x) for x in table.column("cells").to_pylist()]
        every = np.sort(np.concatenate(lists))
        often = np.unique(every[1:][every[1:] == every[:-1]])
        by = {}
        for block, x in zip(table.column("block").to_pylist(), lists):
            by.setdefault(block, []).append(x[within(x, often)])
        rows = [(block, pack(x)) for block, v in by.items() if len(x := np.unique(np.concatenate(v)))]
        seed, part = table.column("seed")[0], table.column("slice")[0]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.string()), "seed": pa.array([seed.as_py()] * len(rows), pa.int32()),
                         "slice": pa.array([part.as_py()] * len(rows), pa.int64()), "cells": pa.array([r[1] for r in rows], pa.binary())})

    return sketches.groupBy("seed", "slice").applyInArrow(run, "block string, seed int, slice bigint, cells binary")


CELLS = pa.schema([("seed", pa.int32()), ("slice", pa.int64()), ("cells", pa.binary())])
FIRSTS = pa.schema([("firsts", pa.binary())])


class Estimate:
    """Which windows of a block the sketch holds for repeated."""

    def __init__(self, path: str, block: str, bits: int):
        rows = sorted(answers(path, block, CELLS).to_pylist(), key=lambda r: (r["seed"], r["slice"]))
        self.bits = bits
        self.often = [np.concatenate([np.zeros(0, np.uint64), *(unpack(r["cells"]) for r in rows if r["seed"] == k)]) for k in range(len(SEEDS))]

    def __call__(self, anchor: np.ndarray) -> np.ndarray:
        if not len(anchor):
            return np.zeros(0, bool)
        turn = np.concatenate([[True], anchor[1:] != anchor[:-1]])  # neighbouring windows mostly share their anchor
        value = anchor[turn]
        found = np.ones(len(value), bool)
        for seed, often in zip(SEEDS, self.often):
            found[found] = within(cells(value[found], seed, self.bits), often)
        return found[np.cumsum(turn) - 1]


def mark(high: np.ndarray, low: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One value for a window's key and place."""
    return mix(high ^ mix(low.astype(np.uint64) ^ mix(ids.view(np.uint64) ^ mix(start.astype(np.uint64)))))


def candidates(docs: DataFrame, path: str, n: int, gram: int, bits: int, key_shift: int) -> DataFrame:
    """``(block, slice, rows)``: windows estimated as repeated, the first of each key in what a task gathered."""

    def run(batches):
        rolling, held, size, now, known = Rolling(), [], 0, None, None

        def send(block):
            high, low, ids, start = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((start, ids, low, high))
            high, low, ids, start = high[order], low[order], ids[order], start[order]
            fresh = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])[:len(high)]
            high, low, ids, start = high[fresh], low[fresh], ids[fresh], start[fresh]
            rows = [(block, k, pa.compress(high[a:b].astype("<u8").tobytes() + low[a:b].astype("<u4").tobytes() + ids[a:b].astype("<i8").tobytes() + start[a:b].astype("<u4").tobytes(), "zstd", asbytes=True), b - a)
                    for k, a, b in pieces(high, key_shift)]
            cols = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.int64()))], ["block", "slice", "rows", "n"])

        for batch in batches:
            for block, part in in_blocks(batch):
                if held and (block != now or size >= SEND):
                    yield send(now)
                    held, size = [], 0
                if block != now:
                    now, known = block, Estimate(path, block, bits)
                w = Windows(part.column(0), part.column(1), rolling, n, gram)
                found = known(w.anchor)
                if found.any():
                    held.append((w.high[found], w.low[found], w.ids[w.row[found]], w.start[found]))
                    size += int(found.sum())
        if held:
            yield send(now)

    return docs.mapInArrow(run, "block string, slice bigint, rows binary, n bigint")


def firsts(found: DataFrame) -> DataFrame:
    """``(block, firsts)``: marks of the first window of each key, grouped exactly by key. A group is one slice of the
    key space; a key has at most one row for what a task gathered once."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        cols = []
        for data, n in zip(table.column("rows").to_pylist(), table.column("n").to_pylist()):
            data = pa.decompress(data, 24 * n, "zstd", asbytes=True)
            cols.append((np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n), np.frombuffer(data, "<i8", n, 12 * n), np.frombuffer(data, "<u4", n, 20 * n)))
        high, low, ids, start = (np.concatenate(c) for c in zip(*cols))
        source = np.repeat(np.arange(len(cols)), [len(c[0]) for c in cols])
        order = np.lexsort((start, ids, low, high))
        high, low, ids, start, source = high[order], low[order], ids[order], start[order], source[order]
        fresh = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(high)), 0))
        first = (ids == ids[lead]) & (start == start[lead])
        value, source = mark(high[first], low[first], ids[first], start[first]), source[first]
        order = np.argsort(source, kind="stable")
        value, source = value[order], source[order]
        edges = np.searchsorted(source, np.arange(len(blocks) + 1))
        return pa.table({"block": pa.array(blocks, pa.string()), "firsts": pa.array([value[a:b].astype("<u8").tobytes() for a, b in zip(edges, edges[1:])], pa.binary())})

    return found.groupBy("slice").applyInArrow(run, "block string, firsts binary")


def repeated_passages(docs: DataFrame, n_words: int = WORDS, gram: int = GRAM, slice_cells: int = SLICE_CELLS) -> DataFrame:
    """``(doc_id, text, n_words, n_removed, spans)``, one row per row of ``docs``. ``text`` is what stays, its words joined
    by one space; ``spans`` lists ``(start, end)`` of the removed words, numbered from 0, end exclusive.

    A word goes if a window of ``n_words`` words over it starts earlier as well: in a document with a smaller id, or
    earlier in the same one. Windows are judged on the input. Words are runs of anything but ``[\\x20\\x09-\\x0D]``. A null
    text has no words, and a text of fewer than ``n_words`` words keeps all of them. A null ``doc_id`` counts as the smallest
    id. Rows that repeat an id are one document in this order: windows that start at the same place of both stay in
    both, so repeated rows come out alike. Texts of any length pass whole; a task holds one of them at a time. An empty table gives
    an empty result. Further columns are ignored.
    """
    if not 0 < gram <= n_words:
        raise ValueError("gram must be between 1 and n_words")
    spark = docs.sparkSession
    small_batches(spark)
    base = staged(id_and_text(docs), "repeat-texts")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, (size // 6).bit_length())
    shift = min(bits, slice_cells.bit_length() - 1)
    key_shift = 64 - max(0, bits - (slice_cells.bit_length() - 3))  # few windows are candidates, but each takes 24 bytes
    hot = by_block(merge(sketch(base, n_words, gram, bits, shift)), "repeat-cells")
    first = by_block(firsts(candidates(base, hot, n_words, gram, bits, min(63, key_shift))), "repeat-firsts")

    def run(batches):
        rolling, now, known, stay = Rolling(), None, None, None
        for batch in batches:
            for block, part in in_blocks(batch):
                if block != now:
                    now, known = block, Estimate(hot, block, bits)
                    stay = np.sort(np.frombuffer(b"".join(answers(first, block, FIRSTS).column("firsts").to_pylist()), "<u8"))
                w = Windows(part.column(0), part.column(1), rolling, n_words, gram)
                found = np.flatnonzero(known(w.anchor))
                gone = found[~within(mark(w.high[found], w.low[found], w.ids[w.row[found]], w.start[found]), stay)]
                size = len(w.index) + 1
                lost = np.cumsum(np.bincount(w.at[gone], minlength=size) - np.bincount(w.at[gone] + n_words, minlength=size))[:-1] > 0
                words = np.array(w.words, object)
                texts, removed, spans = [], [], []
                for a, b in zip(w.bounds, w.bounds[1:]):
                    inside = lost[a:b]
                    removed.append(int(inside.sum()))
                    kept = w.index[a:b]
                    if removed[-1]:
                        turns = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))).reshape(-1, 2)
                        spans.append([{"start": int(x), "end": int(y)} for x, y in turns])
                        kept = kept[~inside]
                    else:
                        spans.append([])
                    texts.append(" ".join(words[kept]))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(texts, pa.string()), pa.array(np.diff(w.bounds)), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "text", "n_words", "n_removed", "spans"])

    return base.mapInArrow(run, "doc_id bigint, text string, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
