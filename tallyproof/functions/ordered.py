"""Running totals and previous-row values that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(seq)`` sends a whole key to one task. Here every key is cut into
*blocks*: columns that do not decrease along the order (``seq div 65536``, the date, ...). The window runs inside a
block; one summary row per block is chained over the blocks of a key and joined back. Only the summaries of a key
(rows / block size) meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SEQ_BLOCK = 1 << 16


def seq_block(col: str | Column = "seq", size: int = SEQ_BLOCK) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(size)).cast("bigint")


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality over column pairs; planned as an equi-join."""
    return reduce(lambda a, b: a & b, [left[l].eqNullSafe(right[r]) for l, r in pairs])


def _blocked(df: DataFrame, keys: list[str], block: dict[str, Column]) -> DataFrame:
    """``df`` with its keys and blocks as one column ``_part``. Windows, groups and joins on that column are all dealt alike, so
    rows are shuffled once; fields that are NULL on both sides are equal inside it."""
    part = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[c.alias(f"b{i}") for i, c in enumerate(block.values())])
    return df.withColumn("_part", part).drop(*keys)


def _unblocked(df: DataFrame, keys: list[str]) -> list[Column]:
    return [F.col("_part")[f"k{i}"].alias(k) for i, k in enumerate(keys)]


def _several(rows: DataFrame, base: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of ``base`` whose first key has more than one block in ``rows``; only their blocks have anything to hand on."""
    at = F.struct(*[F.col("_part")[f"b{i}"] for i in range(n_blocks)])
    wide = rows.groupBy(F.struct(F.col("_part")["k0"]).alias("_first")).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo <> hi").select("_first")
    return base.withColumn("_first", F.struct(F.col("_part")["k0"])).join(wide, "_first", "left_semi").drop("_first")


def chain(df: DataFrame, keys: list[str], block: dict[str, Column], order: list[str],
          sums: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Add columns to ``df``: ``sums`` are inclusive running totals, ``previous`` are values of the row before.

    ``order`` must be a total order inside ``keys`` and ``block`` must not decrease along it. ``rows`` may be any table that is
    cheaper to read, has the columns of the first key and the blocks, and holds at least their values.
    """
    sums, previous = sums or {}, previous or {}
    base = df
    for n, c in {**sums, **previous}.items():
        base = base.withColumn(f"_v_{n}", c)
    for o in order:  # an order column that is a key is the same all through a key
        if o in keys:
            base = base.withColumn(f"_o_{o}", F.col(o))
    order = [f"_o_{o}" if o in keys else o for o in order]
    base = _blocked(base, keys, block)
    nb = len(block)
    w = W.partitionBy("_part").orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = base.select(
        "*",
        *[F.sum(f"_v_{n}").over(upto).alias(f"_s_{n}") for n in sums],
        *[F.lag(F.struct(f"_v_{n}")).over(w).alias(f"_p_{n}") for n in previous],
    )
    aggs = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    if previous:
        aggs.append(F.max_by(F.struct(*[f"_v_{n}" for n in previous]), F.struct(*order)).alias("_last"))
    wb = W.partitionBy("_key").orderBy("_at")
    before = wb.rowsBetween(W.unboundedPreceding, -1)
    wide = _blocked(rows.select(keys[0], *[c.alias(f"_b{i}") for i, c in enumerate(block.values())]), keys[:1], {f"_b{i}": F.col(f"_b{i}") for i in range(nb)}) if rows is not None else base
    carry = _several(wide, base, nb).groupBy("_part").agg(*aggs).select(
        "*", F.struct(*[F.col("_part")[f"k{i}"] for i in range(len(keys))]).alias("_key"), F.struct(*[F.col("_part")[f"b{i}"] for i in range(nb)]).alias("_at"))
    carry = carry.select(
        "_part",
        *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums],
        *([F.lag("_last").over(wb).alias("_olast")] if previous else []),
    )
    out = local.join(carry, "_part", "left")
    added = [
        F.when(F.col(f"_s_{n}").isNull() & F.col(f"_o_{n}").isNull(), F.lit(None))
        .otherwise(F.coalesce(f"_s_{n}", F.lit(0)) + F.coalesce(f"_o_{n}", F.lit(0))).alias(n) for n in sums
    ] + [
        F.when(F.col(f"_p_{n}").isNotNull(), F.col(f"_p_{n}")[f"_v_{n}"]).otherwise(F.col("_olast")[f"_v_{n}"]).alias(n)
        for n in previous
    ]
    gone = {**sums, **previous}
    of_key = dict(zip(keys, _unblocked(out, keys)))
    return out.select(*[of_key.get(c, F.col(c)) for c in df.columns if c not in gone], *added)


def number_rows(df: DataFrame, keys: list[str], block: dict[str, Column], order: list[str], name: str = "seq", rows: DataFrame | None = None) -> DataFrame:
    """1-based ordinal along ``order`` inside ``keys``."""
    return chain(df, keys, block, order, sums={name: F.lit(1).cast("bigint")}, rows=rows)


def first_per_key(df: DataFrame, keys: list[str], order: list, k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key. The filter sits on the window, so Spark plans a group limit before the shuffle
    and at most ``k`` rows per key leave each task."""
    out = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def number_runs(df: DataFrame, keys: list[str], block: dict[str, Column], order: list[str], value: str, joined, name: str) -> DataFrame:
    """Number the runs along ``order`` inside ``keys``: a row stays in the run of the row before it where
    ``joined(previous_value, value)`` holds, else it opens a new run. Adds ``name`` (not dense, only distinct per run)."""
    nb = len(block)
    base = _blocked(df, keys, block)
    w = W.partitionBy("_part").orderBy(*order)
    opens = lambda prev, cur: F.when(joined(prev, cur), 0).otherwise(1)

    def opened(d: DataFrame) -> DataFrame:
        d = d.withColumn("_prev", F.lag(F.struct(F.col(value).alias("v"))).over(w)).select("*", *_unblocked(d, keys))  # ``joined`` may name a key
        return d.withColumn("_open", F.when(F.col("_prev").isNull(), 0).otherwise(opens(F.col("_prev")["v"], F.col(value)))).drop("_prev", *keys)

    inside = opened(base).withColumn("_in", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    carry = opened(_several(base, base, nb)).groupBy("_part").agg(
        F.sum("_open").alias("_t"), F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_first"),
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_final"))
    carry = carry.select("*", F.struct(*[F.col("_part")[f"k{i}"] for i in range(len(keys))]).alias("_key"), F.struct(*[F.col("_part")[f"b{i}"] for i in range(nb)]).alias("_at"))
    wb = W.partitionBy("_key").orderBy("_at")
    carry = carry.select("*", *_unblocked(carry, keys)).withColumn("_head", opens(F.lag("_final").over(wb)["v"], F.col("_first")["v"]))
    carry = carry.select(
        "_part",
        (F.sum("_head").over(wb.rowsBetween(W.unboundedPreceding, W.currentRow))
         + F.coalesce(F.sum("_t").over(wb.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_base"))
    out = inside.join(carry, "_part", "left")
    of_key = dict(zip(keys, _unblocked(out, keys)))
    return out.select(*[of_key.get(c, F.col(c)) for c in df.columns], (F.coalesce("_base", F.lit(1)) + F.col("_in")).alias(name))
