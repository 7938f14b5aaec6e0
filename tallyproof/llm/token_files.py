"""Token ids in binary shards: one zstandard frame for each document, a shared dictionary, an index of offsets.

A shard is ``magic, width, dictionary hash | frames | doc_ids, offsets, n_tokens | footer``. The footer gives
the number of documents, how many of them have no id (they come first), and where the index begins, so a short document is
read by three small range reads. The dictionary is trained on serialised ids of a bounded sample and lies beside the
shards under its hash; a reader refuses a shard that names another one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.llm.common import id_and_text, new_path, sample, small_batches, stored
from tallyproof.llm.tokens import encoder

MAGIC = b"TOKSHRD1"
HEAD, FOOT = "<8sB32s", "<QQQ8s"
HEAD_SIZE, FOOT_SIZE = struct.calcsize(HEAD), struct.calcsize(FOOT)
#: The dictionary is trained on at most so many documents of at most so many characters.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_BYTES = 2_000, 8_192, 1 << 16
LEVEL = 3


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that Spark names, on any store pyarrow knows."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def train(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """Dictionary over serialised ids; empty only where no document has a short text. A sample too small or too uniform to
    learn from is itself the dictionary, as content that frames refer to."""
    import zstandard

    encode = encoder(tokenizer)
    short = id_and_text(docs).where(F.length("text").between(1, SAMPLE_CHARS))
    ids, bounds = encode(pa.array([r.text for r in sample(short, SAMPLE_DOCUMENTS).collect()], pa.string()))
    rows = [np.append(ids[x:y], end_id).astype(f"<u{width}").tobytes() for x, y in zip(bounds, bounds[1:])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(rows)[-DICTIONARY_BYTES:]


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1) -> DataFrame:
    """Write all documents in ascending ``doc_id`` order (nulls first, repeated ids by text) and return the stored
    list of shards ``(shard, path, n_docs, n_tokens, n_bytes, dictionary)``; ``path`` is beside ``<hash>.dict``.

    A null text is the end id alone. Each attempt of a task writes a file of its own, and only the list says which
    count, so a lost executor or a repeated task leaves no wrong shard. An empty table gives no shard.
    """
    from tokenizers import Tokenizer
    import zstandard

    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "tokens")
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train(docs, tokenizer, end_id, width)
    mark = hashlib.sha256(dictionary).digest()
    where, path = place(folder)
    where.create_dir(path, recursive=True)
    with where.open_output_stream(f"{path}/{mark.hex()}.dict") as f:
        f.write(dictionary)

    def run(batches):
        task = TaskContext.get()
        encode = encoder(tokenizer)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True).compress
        out, ids, sizes, counts, nulls, at, end = None, [], [], [], 0, HEAD_SIZE, end_id.to_bytes(width, "little")
        name = f"{path}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        for batch in batches:
            flat, bounds = encode(batch.column(1))
            flat = flat.astype(f"<u{width}")
            for doc_id, low, high in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if out is None:
                    store, _ = place(folder)
                    out = store.open_output_stream(name)
                    out.write(struct.pack(HEAD, MAGIC, width, mark))
                frame = press(flat[low:high].tobytes() + end)
                out.write(frame)
                nulls += doc_id is None
                ids.append(doc_id or 0)
                sizes.append(at)
                counts.append(high - low + 1)
                at += len(frame)
        if out is not None:
            for values in (ids, sizes, counts):
                out.write(np.array(values, "<i8").tobytes())
            out.write(struct.pack(FOOT, len(ids), nulls, at, MAGIC))
            out.close()
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([task.partitionId()], pa.int64()), "path": [f"{folder}/{name.rsplit('/', 1)[1]}"],
                "n_docs": [len(ids)], "n_tokens": [sum(counts)], "n_bytes": [at], "dictionary": [mark.hex()]})

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, "shard bigint, path string, n_docs bigint, n_tokens bigint, n_bytes bigint, dictionary string"), "shards")


class Shard:
    """One shard opened for reading."""

    def __init__(self, path: str, dictionary: bytes | None = None):
        import zstandard

        store, name = place(path)
        self.file = store.open_input_file(name)
        self.file.seek(self.file.size() - FOOT_SIZE)
        n, self.nulls, self.index, magic = struct.unpack(FOOT, self.file.read(FOOT_SIZE))
        self.file.seek(0)
        head, self.width, mark = struct.unpack(HEAD, self.file.read(HEAD_SIZE))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{path} is no shard")
        if dictionary is None:
            with store.open_input_file(f"{name.rsplit('/', 1)[0]}/{mark.hex()}.dict") as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != mark:
            raise ValueError(f"{path} was written with another dictionary")
        self.file.seek(self.index)
        self.doc_ids, self.offsets, self.n_tokens = np.frombuffer(self.file.read(24 * n), "<i8").reshape(3, n)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=known).decompress

    def ids(self, row: int) -> np.ndarray:
        """Token ids of the document in this row, by one range read."""
        end = int(self.offsets[row + 1]) if row + 1 < len(self.offsets) else self.index
        self.file.seek(int(self.offsets[row]))
        return np.frombuffer(self.unpack(self.file.read(end - int(self.offsets[row]))), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> list[int]:
        """Rows of a document; ids ascend, those without come first."""
        own = self.doc_ids[self.nulls:]
        return list(range(*(self.nulls + np.searchsorted(own, [doc_id, doc_id + 1]))))


def read(spark: SparkSession, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document, from the files. ``start`` counts the ids of
    all documents before it. One task reads one shard; the driver sees one row for each shard."""
    rows, start = [], 0
    for r in sorted(shards.select("shard", "path", "n_tokens").collect()):
        rows.append((r.path, start))
        start += r.n_tokens
    listed = spark.createDataFrame(rows, "path string, start bigint").repartition(max(1, len(rows)), "path")

    def run(batches):
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(path)
                starts = start + np.concatenate([[0], np.cumsum(shard.n_tokens)])
                for low in range(0, len(shard.doc_ids), 1024):
                    span = range(low, min(low + 1024, len(shard.doc_ids)))
                    found = [shard.ids(i).tobytes() for i in span]
                    cols = {"doc_id": pa.array([None if i < shard.nulls else int(shard.doc_ids[i]) for i in span], pa.int64()),
                            "start": pa.array(starts[low:span.stop]), "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x) for x in found], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array(found, pa.binary())
                    yield pa.RecordBatch.from_pydict(cols)

    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
