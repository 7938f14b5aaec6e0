"""Token ids of whole texts by the ``tokenizers`` library, each distinct piece of an Arrow batch encoded once.

The tokenizers used here never join characters across a blank or a line feed, so texts are cut there, Arrow numbers the
distinct pieces of a batch, the library encodes those that the worker does not remember, all in one call, and the ids of all texts
are put together by index arrays.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyproof.llm.common import worker_store
from tallyproof.llm.words import slices

#: A piece that ends in marks after a letter or digit: the library parts them, so both sides are encoded by themselves. Letters here
#: stay one letter in lower case and by composition; a mark is ASCII and no apostrophe, which may begin a word.
MARKED = r"(?s)^(?P<a>.*[a-z0-9à-öø-ÿ])(?P<b>[!-&(-/:-@\[-`{-~]+)$"
#: Pieces in one generation of a worker's memory, which keeps two: what is used again moves to the younger one.
CACHE_PIECES = 200_000
#: Texts cut and numbered at once.
PART_BYTES = 2 << 20


def encoder(path: str, cache_pieces: int = CACHE_PIECES):
    """A function from an Arrow array of texts to ``(ids, bounds)``: row ``r`` has ``ids[bounds[r]:bounds[r + 1]]``, as
    little-endian unsigned 32-bit integers. ``path``: a tokenizer file whose pre-tokenizer drops white space."""
    store = worker_store()
    if ("encoder", path) in store:
        return store["encoder", path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    memory: list[dict[str, bytes]] = [{}, {}]

    def of_parts(parts: list[str]) -> list[bytes]:
        young, old = memory
        known = list(map(young.get, parts))
        gone = [i for i, ids in enumerate(known) if ids is None]
        for i in gone:
            known[i] = old.get(parts[i])
        new = [i for i in gone if known[i] is None]
        for low in range(0, len(new), 10_000):
            some = new[low:low + 10_000]
            ids = [e.ids for e in tok.encode_batch_fast([parts[i] for i in some], add_special_tokens=False)]
            blob = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
            ends = (4 * np.cumsum([len(x) for x in ids])).tolist()
            for i, x, y in zip(some, [0, *ends], ends):
                known[i] = blob[x:y]
        if len(young) >= cache_pieces:
            memory[:] = young, _ = {}, young
        young.update((parts[i], known[i]) for i in gone if len(parts[i]) < 64)
        return known

    def gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretches of ``flat`` that begin at ``first`` with ``n`` values, one after the other, and where each ends."""
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])], ends

    def of_pieces(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        two = pc.and_not(pc.match_substring_regex(pieces, MARKED), pc.match_substring(pieces, "<|"))
        pair = pc.extract_regex(pieces.filter(two), MARKED)
        found = pa.concat_arrays([pieces.filter(pc.invert(two)), pair.field("a"), pair.field("b")]).dictionary_encode()
        known = of_parts(found.dictionary.to_pylist())
        two, at = two.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False)
        start = np.cumsum(1 + two) - 1 - two
        parts, whole = np.empty(len(pieces) + len(pair), np.int64), len(pieces) - len(pair)
        parts[start[~two]], parts[start[two]], parts[start[two] + 1] = at[:whole], at[whole:len(pieces)], at[len(pieces):]
        size = np.array(list(map(len, known)), np.int64) // 4
        flat, ends = gathered(np.frombuffer(b"".join(known), "<u4"), (np.cumsum(size) - size)[parts], size[parts])
        return flat, ends[start], ends[start + 1 + two] - ends[start]

    def encode_part(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # marks of special tokens are told apart by case
            texts = pc.ascii_lower(texts)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found = cut.flatten().dictionary_encode()
        flat, first, size = of_pieces(found.dictionary)
        index = found.indices.to_numpy(zero_copy_only=False)
        ids, ends = gathered(flat, first[index], size[index])
        offsets = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        return ids, ends[offsets]

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = [encode_part(texts.slice(low, high - low)) for low, high in slices(texts, PART_BYTES)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(p[0] for p in parts)])
        before = np.cumsum([0, *(len(p[0]) for p in parts)])
        return ids, np.concatenate([[0], *(p[1][1:] + k for p, k in zip(parts, before))]).astype(np.int64)

    store["encoder", path] = encode
    return encode
