"""Alignment of the tokens of two tokenizers over the same text, and how common each linked pair of ids is.

Both tokenisations are complete before they are compared. Where both have a token end and the next token of both is marked as
beginning with a space, the text is cut: those are anchors, checked on byte offsets. What lies between two anchors is a window of
ids, mostly one word, and how its tokens group depends on its ids alone, so it is worked out once for each pair of id tuples
and looked up afterwards. The counts of linked pairs are summed over blocks of documents (``blocks``): a block asks for the pairs
it has, each once, so a pair that stands in every document moves once for each block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyproof.llm.blocks import answers, by_block, in_blocks, staged
from tallyproof.llm.common import id_and_text, small_batches, stored, worker_store
from tallyproof.llm.words import mix, slices

BEYOND_LATIN = re.compile("[^\0-\xff]")
#: Windows that a worker remembers, and the most ids of one that is worth it.
MEMO, MEMO_IDS = 200_000, 64
#: Pairs that a task gathers before it sends them.
SEND = 1 << 20


class Vocabulary:
    """Bytes and lengths of the tokens of a tokenizer by id, and which begin with a space."""

    def __init__(self, tokens: list[bytes]):
        self.bytes = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t[:1] == b" " for t in tokens], bool)


def byte_decoder() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones for themselves, the others
    for characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


def byte_level(path: str):
    """``(encode, vocabulary)`` of a byte-level BPE file; ``encode`` gives the ids of each text of a list.

    Texts of Latin-1 characters go through the same vocabulary as ranks, which is several times faster, if the file's ids follow its merges and its
    words are those of ``public_tokenizers.PATTERN``; on other characters the two libraries' tables of letters may differ."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok, table = Tokenizer.from_file(path), byte_decoder()
    tok.encode_special_tokens = True  # their strings in a text are plain text
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    tokens, ranks = [b""] * tok.get_vocab_size(), {}
    for token, i in tok.get_vocab().items():
        tokens[i] = token.encode() if token in special else bytes(table[c] for c in token)
        if token not in special:
            ranks[tokens[i]] = i
    parts = json.loads(tok.to_str())
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in parts["model"]["merges"]]
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    fast = None
    if parts["pre_tokenizer"] == plain and parts["normalizer"] is None and all(tok.token_to_id(m) == 256 + k for k, m in enumerate(merged)):
        fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(texts: list[str]) -> list[list[int]]:
        easy = [fast is not None and (t.isascii() or not BEYOND_LATIN.search(t)) for t in texts]
        rest = iter(tok.encode_batch([t for t, e in zip(texts, easy) if not e], add_special_tokens=False))
        return [fast(t) if e else next(rest).ids for t, e in zip(texts, easy)]

    return encode, Vocabulary(tokens)


def pieces(path: str):
    """The same of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def token(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    return lambda texts: model.encode(texts, num_threads=1), Vocabulary([token(i) for i in range(model.vocab_size())])


def coders(path_a: str, path_b: str):
    store = worker_store()
    if ("coders", path_a, path_b) not in store:
        store["coders", path_a, path_b] = byte_level(path_a), pieces(path_b)
    return store["coders", path_a, path_b]


class Aligner:
    """Groups and links of windows of ids, each pair of id tuples worked out once.

    A window gives ``(groups, number of groups, pairs, uses)``: every link as a 64-bit pair in ``pairs``, or, where a group
    has many tokens, each pair once and how often in ``uses``, which is empty otherwise.
    """

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b, self.memo, self.older = a, b, {}, {}
        self.long_a, self.long_b, self.names = a.length.tolist(), b.length.tolist(), [str(i) for i in range(max(len(a.length), len(b.length)))]

    def window(self, a: list[int], b: list[int]) -> tuple[str, int, bytes, bytes]:
        long_a, long_b, name = self.long_a, self.long_b, self.names
        text, pairs, uses, i, j = [], [], None, 0, 0
        while i < len(a):
            x, y = a[i], b[j]
            i, j, ahead = i + 1, j + 1, long_a[x] - long_b[y]
            if not ahead:
                text.append(name[x] + "|" + name[y])
                pairs.append(x << 32 | y)
                if uses is not None:
                    uses.append(1)
                continue
            one, two = [x], [y]
            while ahead:
                if ahead < 0:
                    one.append(a[i])
                    ahead, i = ahead + long_a[a[i]], i + 1
                else:
                    two.append(b[j])
                    ahead, j = ahead - long_b[b[j]], j + 1
            text.append(",".join([name[x] for x in one]) + "|" + ",".join([name[y] for y in two]))
            if len(one) * len(two) <= 4096:
                pairs += [x << 32 | y for x in one for y in two]
                if uses is not None:
                    uses += [1] * (len(one) * len(two))
            else:
                (one, n_one), (two, n_two) = (np.unique(x, return_counts=True) for x in (one, two))
                uses = ([1] * len(pairs) if uses is None else uses) + (n_one[:, None] * n_two).ravel().tolist()
                pairs += ((one.astype(np.int64) << 32)[:, None] + two).ravel().tolist()
        return ";".join(text), len(text), array("Q", pairs).tobytes(), b"" if uses is None else array("Q", uses).tobytes()

    def known(self, a: bytes, b: bytes) -> tuple[str, int, bytes, bytes]:
        """The same of ids as 32-bit values, from memory where the window was seen."""
        found = self.memo.get((a, b))
        if found is not None:
            return found
        found = self.older.get((a, b)) or self.window(array("I", a).tolist(), array("I", b).tolist())
        if len(a) + len(b) <= 4 * MEMO_IDS:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[a, b] = found
        return found

    def documents(self, lists_a: list[list[int]], lists_b: list[list[int]]) -> list[tuple[str, int, int, np.ndarray, np.ndarray]]:
        """``(groups, number of groups, number of links, pairs, uses)`` of documents whose tokens have equal bytes, each pair once."""
        if not lists_a:
            return []
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (lists_a, lists_b))
        docs_a, docs_b = (np.cumsum([0, *map(len, x)]) for x in (lists_a, lists_b))
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        at = np.searchsorted(end_a, end_b)
        before_a, before_b = np.append(self.a.spaced[a[1:]], True), np.append(self.b.spaced[b[1:]], True)
        before_a[docs_a[1:] - 1] = before_b[docs_b[1:] - 1] = True
        anchor = np.flatnonzero((end_a[at] == end_b) & before_a[at] & before_b)
        low_b, high_b = np.append(0, anchor[:-1] + 1), anchor + 1
        high_a = at[anchor] + 1
        low_a = np.append(0, high_a[:-1])
        # windows with equal ids, by 128 bits of their ids
        one, two = (self.rolled(a, low_a, high_a, k) ^ self.rolled(b, low_b, high_b, k + 2) for k in (0, 1))
        order = np.lexsort((two, one))
        fresh = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        lead = order[fresh]
        raw_a, raw_b = a.astype(np.uint32).tobytes(), b.astype(np.uint32).tobytes()
        found = [self.known(raw_a[w:x], raw_b[y:z]) for w, x, y, z in zip(*((4 * edge[lead]).tolist() for edge in (low_a, high_a, low_b, high_b)))]
        text, groups, pairs, uses = zip(*found)
        size = np.array([len(p) // 8 for p in pairs], np.int64)
        once = np.frombuffer(b"".join(pairs), "<u8").astype(np.int64)
        times = np.concatenate([np.frombuffer(u, "<u8").astype(np.int64) if u else np.ones(n, np.int64) for u, n in zip(uses, size.tolist())]) if any(uses) else None
        first, n = np.cumsum(size) - size, size[number]
        ends = np.cumsum(n)
        spot = np.repeat(first[number] - (ends - n), n) + np.arange(ends[-1])
        edges = np.searchsorted(high_a, docs_a)  # the first window of each document
        edges[1:] += 1
        row = np.repeat(np.repeat(np.arange(len(lists_a)), np.diff(edges)), n)
        pair = once[spot]
        wide = len(self.b.bytes)
        key, back, count = np.unique((row * len(self.a.bytes) + (pair >> 32)) * wide + (pair & 0xFFFFFFFF), return_inverse=True, return_counts=True)
        if times is not None:
            count = np.zeros(len(key), np.int64)
            np.add.at(count, back, times[spot])
        head, tail = np.divmod(key, wide)
        row, head = np.divmod(head, len(self.a.bytes))
        pair = (head << 32) + tail
        cuts = np.searchsorted(row, np.arange(len(lists_a) + 1))
        groups = np.array(groups, np.int64)[number]
        out = []
        for r, (low, high) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            x, y = cuts[r], cuts[r + 1]
            out.append((";".join([text[k] for k in number[low:high].tolist()]), int(groups[low:high].sum()), int(count[x:y].sum()), pair[x:y], count[x:y]))
        return out

    @staticmethod
    def rolled(ids: np.ndarray, low: np.ndarray, high: np.ndarray, lane: int) -> np.ndarray:
        """A 64-bit hash of the ids of each window, by their place in it."""
        width = high - low
        place = (np.arange(len(ids)) - np.repeat(low, width)).astype(np.uint64)
        value = mix(mix(ids.astype(np.uint64) + np.uint64(lane << 40)) + place)
        return np.add.reduceat(value, low)


def aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, uses[, groups])``: ``pairs`` are the document's linked
    pairs as 64-bit values (id of A above, of B below), ``uses`` how many links each has, both as little-endian bytes."""

    def run(batches):
        (encode_a, voc_a), (encode_b, voc_b) = coders(path_a, path_b)
        aligner = Aligner(voc_a, voc_b)
        for whole in batches:
            for low, high in slices(whole.column(1)):
                batch = whole.slice(low, high - low)
                raw = [t or "" for t in batch.column(1).to_pylist()]
                both = list(zip(encode_a([" " + t for t in raw]), encode_b(raw)))
                whole_ones = [bool(t) and b"".join(map(voc_a.bytes.__getitem__, a)) == (w := (" " + t).encode()) and b"".join(map(voc_b.bytes.__getitem__, b)) == w
                              for t, (a, b) in zip(raw, both)]
                found = iter(aligner.documents([a for (a, _), ok in zip(both, whole_ones) if ok], [b for (_, b), ok in zip(both, whole_ones) if ok]))
                rows = []
                for (a, b), ok in zip(both, whole_ones):
                    if not ok:
                        rows.append((0, 0, 0, 0, "", b"", b"", ""))
                        continue
                    groups, n_groups, n_links, pairs, uses = next(found)
                    rows.append((len(a), len(b), n_groups, n_links, hashlib.sha256(groups.encode()).hexdigest(), pairs.astype("<u8").tobytes(), uses.astype("<u4").tobytes(), groups))
                cols = list(zip(*rows))[:7 + with_groups]
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * 2 + [pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "uses", "groups"][:8 + with_groups])

    return id_and_text(docs).mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, uses binary"
                                        + ", groups string" * with_groups)


def pair_counts(found: DataFrame) -> DataFrame:
    """``(block, pair, documents)``: in how many documents of a block, or of a part of it, a pair is linked."""

    def run(batches):
        held, size, now = [], 0, None

        def send():
            pairs, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(pairs), pa.string()), pa.array(pairs.astype(np.int64)), pa.array(counts.astype(np.int64))], ["block", "pair", "documents"])

        for batch in batches:
            for block, part in in_blocks(batch, "pairs"):
                if held and (block != now or size >= SEND):
                    yield send()
                    held, size = [], 0
                now = block
                held.append(np.frombuffer(b"".join(part.column("pairs").to_pylist()), "<u8"))
                size += len(held[-1])
        if held:
            yield send()

    return found.select("pairs", "block").mapInArrow(run, "block string, pair bigint, documents bigint")


COUNTS = pa.schema([("pair", pa.int64()), ("count", pa.int64()), ("best", pa.bool_())])


def pair_table(counts: DataFrame) -> DataFrame:
    """``(pair, count, best)`` over all blocks; ``best``: no pair of the same id of A counts more."""
    whole = counts.groupBy("pair").agg(F.sum("documents").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))  # at most as many rows as B has ids
    return whole.select("pair", "count", (F.col("count") == top).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per row of ``docs``.

    A encodes a space and the text, B the text (and adds the space). Places where tokens of both end cut the tokens into groups;
    each token of A in a group is linked with each of B in it. A pair of ids counts the documents that hold it linked;
    ``count_sum`` adds these counts over the links, ``n_best`` is the number of links whose count is the highest of their id of A.
    Texts that are null, empty or not given back byte by byte by both tokenizers have no tokens: zeros, and no hash but ``''``.
    Rows that repeat are documents of their own. A null ``doc_id`` stays null. Texts of any length pass whole, one
    in a task at a time; a group of many tokens is kept by its distinct pairs. An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = staged(aligned(docs, path_a, path_b), "aligned")
    asked = stored(pair_counts(found), "pair-counts")
    known = by_block(asked.select("block", "pair").distinct().join(pair_table(asked), "pair"), "pair-answers")

    def run(batches):
        now, table = None, None
        for batch in batches:
            for block, part in in_blocks(batch, "pairs"):
                if block != now:
                    now, rows = block, answers(known, block, COUNTS)
                    order = np.argsort(rows.column("pair").to_numpy())
                    table = [rows.column(c).to_numpy()[order] for c in ("pair", "count", "best")]
                lists = part.column("pairs").to_pylist()
                pairs = np.frombuffer(b"".join(lists), "<u8").astype(np.int64)
                uses = np.frombuffer(b"".join(part.column("uses").to_pylist()), "<u4").astype(np.int64)
                at = np.searchsorted(table[0], pairs)
                count = np.array([len(x) // 8 for x in lists], np.int64)
                add = lambda x: np.add.reduceat(np.concatenate([x, [0]]), np.cumsum(count) - count) * (count > 0)
                best, total = add(uses * table[2][at]), add(uses * table[1][at])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(best), pa.array(total), part.column("groups_sha256")],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return found.mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
