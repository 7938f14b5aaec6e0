"""Benchmark decontamination with one FM-index for each shard of the training texts.

A shard is the words of one Arrow batch, bounded in bytes. Words that no test phrase has can be in no occurrence, so
they become separators, and so do runs too short for the shortest phrase; what is left is suffix-sorted and its
Burrows-Wheeler transform stored as a wavelet matrix. All test phrases are searched backwards at once by wavelet
ranks, occurrences are located by walking to a sampled suffix position, and their spans are merged per document.
Benchmarks larger than a block are searched block by block, each read from the shared folder.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyproof.llm.common import new_path, small_batches, worker_store
from tallyproof.llm.token_files import place

WINDOW = 13
#: Bytes that are in no word, after lower-casing A-Z: 00-2F, 3A-60, 7B-7F.
NOT_WORD = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Longest part of a shard that one index covers, in words; parts overlap by a window less one word.
INDEX_WORDS = 1 << 20
SAMPLE_EVERY = 8
#: Characters of benchmark text in a block.
BLOCK_CHARS = 4 << 20


def words(text: str | None) -> list[bytes]:
    if not text:
        return []
    return text.encode("utf-8", "replace").lower().translate(bytes(32 if c in NOT_WORD else c for c in range(256))).split()


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``x`` by prefix doubling. Zeros are separators, each taken as a symbol of its own
    below all words, so no comparison runs past one; the last symbol must be zero."""
    n = len(x)
    cut = x == 0
    rank = np.where(cut, np.cumsum(cut) - 1, x.astype(np.int64) + int(cut.sum()))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        grown = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(grown[1:] != grown[:-1])])
        if fresh[order[-1]] == n - 1:
            return order
        rank, step = fresh, step * 2


class FMIndex:
    """Backward search and location over a sequence of symbols in which 0 separates runs."""

    def __init__(self, x: np.ndarray, symbols: int):
        sa = suffix_array(x)
        last = x[sa - 1]  # row of suffix 0 gets the final separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=symbols))])
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        v = last
        for level in reversed(range(self.bits)):
            bit = (v >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)]))
            self.zeros.append(len(v) - int(self.ones[-1][-1]))
            v = np.concatenate([v[bit == 0], v[bit == 1]])
        marked = (sa % SAMPLE_EVERY == 0) | (last == 0)
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.samples = sa[marked]

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place of the first ``at`` rows among those of ``symbol`` on the lowest level."""
        for k, level in enumerate(reversed(range(self.bits))):
            ones = self.ones[k][at]
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.down(symbol, at) - self.down(symbol, np.zeros_like(at))

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(phrase, low, high)``: the rows whose suffixes begin with each phrase found. ``phrases`` is padded on the left."""
        who = np.arange(len(phrases))
        symbol = phrases[:, -1]
        low, high = self.first[symbol], self.first[symbol + 1]
        width = phrases.shape[1]
        for back in range(1, width + 1):
            live = low < high
            who, low, high = who[live], low[live], high[live]
            more = np.flatnonzero(lengths[who] > back)
            if not len(more):
                return who, low, high
            symbol = phrases[who[more], width - 1 - back]
            low[more] = self.first[symbol] + self.rank(symbol, low[more])
            high[more] = self.first[symbol] + self.rank(symbol, high[more])

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out, walked, open_, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(open_):
            there = self.marks[at + 1] > self.marks[at]
            out[open_[there]] = self.samples[self.marks[at[there]]] + walked
            open_, at = open_[~there], at[~there]
            symbol, node = np.zeros(len(at), np.int64), at
            for k in range(self.bits):
                ones = self.ones[k][node]
                bit = self.ones[k][node + 1] - ones
                symbol, node = symbol * 2 + bit, np.where(bit, self.zeros[k] + ones, node - ones)
            at = self.first[symbol] + node - self.down(symbol, np.zeros_like(at))
            walked += 1
        return out


def phrases_of(items, window: int) -> dict:
    """Distinct windows of these ``(item_id, text)`` rows: symbols of their words, padded, and the items of each."""
    vocabulary, found = {}, {}
    for item, text in items:
        own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        for at in range(max(1, len(own) - window + 1)) if own else ():
            found.setdefault(tuple(own[at:at + window]), set()).add(item)
    table = np.zeros((len(found), window), np.int64)
    for row, phrase in zip(table, found):
        row[window - len(phrase):] = phrase
    return {"vocabulary": vocabulary, "phrases": table, "lengths": np.array([len(p) for p in found], np.int64), "items": list(found.values())}


def occurrences(stream: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """``(phrase, position)`` of every occurrence in a stream of symbols, 0 where no phrase has the word."""
    lengths = block["lengths"]
    known = np.concatenate([[False], stream > 0, [False]])
    begin, end = np.flatnonzero(~known[:-1] & known[1:]), np.flatnonzero(known[:-1] & ~known[1:])
    long = end - begin >= lengths.min()
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(size + 1)
    position = np.arange(ends[-1]) + np.repeat(begin - (ends - size - 1), size + 1)
    x = stream[np.minimum(position, len(stream) - 1)]
    x[ends - 1] = 0
    index = FMIndex(x, len(block["vocabulary"]) + 1)
    who, low, high = index.search(block["phrases"], lengths)
    count = high - low
    rows = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
    return np.repeat(who, count), position[index.locate(rows)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items)``, one row per row of ``docs``;
    with ``carry`` also ``doc``, a struct of all its columns.

    ``spans`` are the merged word ranges ``(start, end)`` covered by any window, end exclusive; ``items`` the sorted
    ids as text. Contaminated: words are hit, and at least one in twenty. A null or empty text has no words. Items
    that repeat an id count once; items without words or without id have no window. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks, folder, files = 1 + size // block_chars, new_path(spark, "phrases"), []
    store, path = place(folder)
    store.create_dir(path, recursive=True)
    for i in range(n_blocks):
        block = phrases_of(items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i).toLocalIterator(), window)
        if len(block["lengths"]):
            files.append(f"{folder}/{i}")
            with store.open_output_stream(f"{path}/{i}") as f:
                f.write(pickle.dumps(block))

    def load(file):
        kept = worker_store()
        if kept.get("phrases", (None,))[0] != file:
            store, path = place(file)
            with store.open_input_file(path) as f:
                kept["phrases"] = file, pickle.loads(f.read())
        return kept["phrases"][1]

    class Seen(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    def run(batches):
        for batch in batches:
            seen, parts = Seen(), []
            for text in batch.column("text"):
                parts.append(np.array(list(map(seen.__getitem__, words(text.as_py()))), np.int64))
            n_words = np.array([len(p) for p in parts], np.int64)
            ends = np.cumsum(n_words + 1)
            starts = ends - n_words - 1
            total = int(ends[-1]) if len(ends) else 0
            stream = np.full(total, len(seen), np.int64)  # one word that is no word after each document
            for p, at in zip(parts, starts):
                stream[at:at + len(p)] = p
            cover, found = np.zeros(total + 1, np.int64), [set() for _ in parts]
            for file in files:
                block = load(file)
                get = block["vocabulary"].get
                symbols = np.array([*(get(w, 0) for w in seen), 0], np.int64)[stream]
                for low in range(0, max(1, total), INDEX_WORDS):
                    who, at = occurrences(symbols[low:low + INDEX_WORDS + window - 1], block)
                    np.add.at(cover, at + low, 1)
                    np.add.at(cover, at + low + block["lengths"][who], -1)
                    pairs = np.unique((np.searchsorted(ends, at + low, "right") << 40) + who)
                    for row, phrase in zip(pairs >> 40, pairs & ((1 << 40) - 1)):
                        found[row] |= block["items"][phrase]
            hit = np.cumsum(cover[:-1]) > 0
            edge = np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            owner = np.searchsorted(ends, begin, "right")
            spans = [[] for _ in parts]
            n_hit = np.zeros(len(parts), np.int64)
            for row, a, b in zip(owner, begin, end):
                spans[row].append({"start": int(a - starts[row]), "end": int(b - starts[row])})
                n_hit[row] += b - a
            named = [sorted(x) for x in found]
            cols = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words), "n_hit": pa.array(n_hit),
                    "n_items": pa.array([len(x) for x in named], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()),
                    "contaminated": pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    "items": pa.array(named, pa.list_(pa.string()))}
            if carry:
                cols["doc"] = batch.column("doc")
            yield pa.RecordBatch.from_pydict(cols)

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if carry else []))
    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    return base.mapInArrow(run, schema + (f", doc {base.schema['doc'].dataType.simpleString()}" if carry else ""))
