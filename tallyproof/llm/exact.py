"""Exact duplicates by distributed radix partitioning from the most significant byte.

Texts are compared after deleting white space. A round looks at the next block of bytes of every text that is still
open: texts of one group that agree on the block form the groups of the next round. A group is settled when it has one
member or when its texts have ended; all members of a group have the same length, which is the first digit. Blocks
grow by a factor, so a text of n bytes takes about log(n) rounds. Bytes are compared themselves, never a digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyproof.llm.common import id_and_text, stored

SPACE = r"[\x20\x09-\x0D]+"
FIRST_BLOCK = 64
GROWTH = 32


def exact_dedup(docs: DataFrame, first_block: int = FIRST_BLOCK, growth: int = GROWTH) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, n_bytes, row)``, one row per row of ``docs``; ``row`` hashes the text.

    Of equal texts the row with the most code points in the original text stays, then the one with the smallest
    ``doc_id``. A null text counts as empty, and all empty texts are equal. A null ``doc_id`` counts as the smallest
    id. Rows that repeat both ``doc_id`` and text count in ``group_size`` and stay or go together. ``text_sha256`` is
    output only. Copies may be any share of all rows: groups are counted by partial aggregates, only groups of
    two or more are joined back, and that join is one Spark splits for hot keys.
    """
    bare = F.encode(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, ""), "UTF-8")
    state = id_and_text(docs).select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"), bare.alias("rest"), F.lit(0).cast("bigint").alias("grp"))
    state = state.select("doc_id", "row", "n_points", "grp", F.octet_length("rest").alias("n_bytes"), F.sha2("rest", 256).alias("text_sha256"), "rest")
    taken, block, settled = 0, first_block, []
    while True:
        keyed = state.withColumn("block", F.substring("rest", 1, block))
        keys = ["grp", "n_bytes", "block"]
        order = F.struct(F.col("n_points"), F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("inverse"))
        groups = keyed.groupBy(*keys).agg(F.count("*").alias("group_size"), F.max_by(F.struct("doc_id"), order).alias("keep"))
        groups = stored(groups.where("group_size > 1").withColumn("next", F.monotonically_increasing_id()), "exact-groups")
        done = F.col("next").isNull() | (F.col("n_bytes") <= taken + block)
        parted = keyed.join(groups.hint("merge"), keys, "left").select(
            "doc_id", "row", "n_points", "n_bytes", "text_sha256",
            F.when(F.col("next").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
            F.coalesce("next", F.lit(-1)).cast("bigint").alias("grp"),
            F.when(~done, F.expr(f"substring(rest, {block + 1})")).alias("rest"), done.cast("int").alias("done"))
        parted = stored(parted, "exact-round", ["done"])
        settled.append(parted.where("done = 1"))
        state = parted.where("done = 0").select("doc_id", "row", "n_points", "grp", "n_bytes", "text_sha256", "rest")
        if state.isEmpty():
            break
        taken, block = taken + block, block * growth
    out = settled[0]
    for part in settled[1:]:
        out = out.union(part)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256", F.col("n_bytes").cast("bigint").alias("n_bytes"), "row")
