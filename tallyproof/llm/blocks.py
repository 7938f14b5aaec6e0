"""Tables in blocks: what each file of a stored table asks for is answered by a file that its tasks read.

A table written to the shared folder keeps its files, so a file is a block that every later scan sees again, whatever task reads
which part of it. Tasks send up what a block has (compact and summed over the block), Spark groups it over all blocks,
and the answers are written by block. No text is shuffled and nothing is broadcast: a task holds the answers of its own block.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs, parquet
from pyspark.sql import DataFrame, functions as F

from tallyproof.llm.common import new_path
from tallyproof.llm.token_files import place
from tallyproof.llm.words import slices


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored, with the name of the file each row lies in as ``block``."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("block"))


def by_block(df: DataFrame, name: str) -> str:
    """Write ``df`` (with ``block``) so that ``answers`` finds the rows of a block; gives the folder."""
    path = new_path(df.sparkSession, name)
    df.repartition("block").write.option("compression", "zstd").partitionBy("block").parquet(path)
    return path


def answers(path: str, block: str, schema: pa.Schema) -> pa.Table:
    """Rows of one block, read in a task; none if the block has none."""
    store, folder = place(path)
    found = store.get_file_info(fs.FileSelector(f"{folder}/block={block}", allow_not_found=True))
    tables = [parquet.read_table(store.open_input_file(f.path), columns=schema.names).cast(schema) for f in found if f.path.endswith(".parquet")]
    return pa.concat_tables(tables) if tables else schema.empty_table()


def in_blocks(batch: pa.RecordBatch, column: str = "text") -> list[tuple[str, pa.RecordBatch]]:
    """The rows of a batch by ``block`` and in parts of about a megabyte of ``column``; a block's rows follow each other."""
    names = batch.column("block").to_pylist()
    cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(names)]):
        part = batch.slice(a, b - a)
        out += [(names[a], part.slice(x, y - x)) for x, y in slices(part.column(column))]
    return out
