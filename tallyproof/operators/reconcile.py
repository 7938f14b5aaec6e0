"""Two-pass, one-to-one reconciliation of paid invoices with bank inflows.

Pass 1 pairs equal references: the k-th paid invoice with a number takes the k-th inflow with that reference.
Pass 2 is first-fit by input order on amount (within 1) and date (within the window). It is order dependent, so it is
cut into *islands* that no pair can cross: runs of amounts with gaps of at most the tolerance, then runs of dates with
gaps of at most the widest window. Islands are settled in three exact ways:

* every invoice fits every inflow: the k-th invoice takes the k-th inflow (a join on rank);
* small mixed islands: first-fit inside a grouped task, bounded by ``task_rows``;
* larger mixed islands: rounds of distributed mutual choice, which yields the same pairs as first-fit because both
  sides rank each other by input order alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import broadcast_if_small
from ..functions.ordered import number_rows, number_runs, seq_block
from ..session import cut

AMOUNT_TOLERANCE = 1
PAID_WINDOW, DUE_WINDOW = 5, 120
ISLAND = ["tenant_id", "a_island", "d_island"]


def _islands(d: DataFrame, keys: list[str], value: str, gap: Column | int, block: Column, name: str) -> DataFrame:
    """Number the runs of ``value`` whose neighbours lie at most ``gap`` apart. Works on distinct values, in blocks."""
    v = d.select(*list(dict.fromkeys(keys + [value]))).distinct()
    v = number_runs(v, keys, {"range": block}, [value], value, lambda before, now: now - before <= gap, name)
    return d.join(v, keys + [value])


def _first_fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """First-fit by input order inside one small island."""
    inv = pdf[pdf.side == "i"].sort_values("seq")
    led = pdf[pdf.side == "l"].sort_values("seq")
    cents, day, seqs = led.cents.to_numpy(), led.day.to_numpy(), led.seq.to_numpy()
    free = pd.Series(True, index=range(len(led))).to_numpy()
    got = []
    for r in inv.itertuples():
        ok = free & (abs(cents - r.cents) <= AMOUNT_TOLERANCE * 100)
        if not pd.isna(r.day):
            ok &= pd.isna(day) | (abs(day - r.day) <= r.days)
        at = ok.argmax() if len(ok) and ok.any() else -1
        if at >= 0:
            free[at] = False
        got.append((key[0], r.seq, int(seqs[at]) if at >= 0 else None))
    return pd.DataFrame(got, columns=["tenant_id", "seq", "l_seq"])


def _by_rank(d: DataFrame, keys: list[str]) -> DataFrame:
    """k-th invoice with k-th inflow inside ``keys``."""
    r = number_rows(d, keys + ["side"], {"range": seq_block()}, ["seq"], "k")
    i = r.where("side = 'i'").select(*keys, "k", "seq")
    l = r.where("side = 'l'").select(*keys, "k", F.col("seq").alias("l_seq"))
    return i.join(l, keys + ["k"], "left").select("tenant_id", "seq", "l_seq")


def _second(pairs: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Smallest and second smallest ``value`` per key."""
    least = pairs.groupBy(*keys).agg(F.min(value).alias(name))
    more = pairs.join(least, keys).where(F.col(value) > F.col(name)).groupBy(*keys).agg(F.min(value).alias(f"{name}_next"))
    return least.join(more, keys, "left")


def _rounds(d: DataFrame) -> DataFrame:
    """Mutual choice in rounds for islands too large for one task.

    Rows with the same amount and date have the same partners, so each round looks at such *cells* only: an invoice
    cell meets at most 201 amounts times the days of its window, however many rows the cells hold. Where the first free
    rows of two cells are each other's earliest, the k-th rows of both pair up as long as no other cell has an earlier
    row to offer either of them. Cells of equal fees are settled in one round, whatever their size.
    """
    spark = d.sparkSession
    left = cut(d)
    done: DataFrame | None = None
    cell = ["cents", "day", "days"]
    while True:
        heads = left.groupBy(*ISLAND, "side", *cell).agg(F.min("seq").alias("head"))
        i = heads.where("side = 'i'").withColumnRenamed("head", "seq")
        l = heads.where("side = 'l'").select(*ISLAND, F.col("cents").alias("c"), "day", F.col("head").alias("l_seq"))
        near = i.withColumn("c", F.explode(F.sequence(F.col("cents") - 100 * AMOUNT_TOLERANCE, F.col("cents") + 100 * AMOUNT_TOLERANCE)))
        near = near.select(*ISLAND, "c", F.col("day").alias("i_day"), "days", "seq")
        pairs = cut(near.join(l, ISLAND + ["c"]).where("i_day is null or day is null or abs(i_day - day) <= days").select(*ISLAND, "seq", "l_seq"))
        want = _second(pairs, ISLAND + ["seq"], "l_seq", "best_l")
        back = _second(pairs, ISLAND + ["l_seq"], "seq", "best_i")
        mutual = want.withColumnRenamed("best_l", "l_seq").join(back.withColumnRenamed("best_i", "seq"), ISLAND + ["seq", "l_seq"])
        mutual = cut(mutual.select(*ISLAND, "seq", "l_seq", "best_l_next", "best_i_next"))
        if mutual.isEmpty():
            break
        # an invoice must come before the next invoice cell its partner could take, an inflow before the next inflow cell
        sides = mutual.select(*ISLAND, F.col("seq").alias("pair"), F.explode(F.array(
            F.struct(F.lit("i").alias("side"), F.col("seq").alias("head"), F.col("best_i_next").alias("bound")),
            F.struct(F.lit("l").alias("side"), F.col("l_seq").alias("head"), F.col("best_l_next").alias("bound")))).alias("s")).select(*ISLAND, "pair", "s.*")
        keys = ISLAND + ["side", "cents"]
        of_cell = heads.join(sides, ISLAND + ["side", "head"]).select(
            *[F.col(c).alias(f"c_{c}") for c in keys + ["day", "days"]], F.col("pair"), F.col("bound"))
        on = [F.col(c) == F.col(f"c_{c}") for c in keys] + [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in ("day", "days")]
        rows = left.join(of_cell, on).where(F.col("bound").isNull() | (F.col("seq") < F.col("bound"))).select(*ISLAND, "pair", "side", "seq")
        new = cut(_by_rank(rows, ISLAND + ["pair"]).where("l_seq is not null"))
        done = new if done is None else done.unionByName(new)
        left = left.join(new.select("tenant_id", "seq", F.lit("i").alias("side")), ["tenant_id", "seq", "side"], "left_anti")
        left = left.join(new.select("tenant_id", F.col("l_seq").alias("seq"), F.lit("l").alias("side")), ["tenant_id", "seq", "side"], "left_anti")
        left = cut(left.select(*d.columns))
    empty = spark.createDataFrame([], "tenant_id string, seq bigint, l_seq bigint")
    return done if done is not None else empty


def by_reference(inv: DataFrame, led: DataFrame) -> DataFrame:
    """Pass 1: (tenant_id, seq, l_seq) of pairs with an equal, non-empty reference."""
    i = inv.where((F.upper("status") == "PAID") & (F.coalesce("invoice_number", F.lit("")) != "")).select(
        "tenant_id", F.col("invoice_number").alias("ref"), F.lit("i").alias("side"), "seq")
    l = led.where((F.col("amount") > 0) & (F.coalesce("reference", F.lit("")) != "")).select(
        "tenant_id", F.col("reference").alias("ref"), F.lit("l").alias("side"), "seq")
    return _by_rank(i.unionByName(l), ["tenant_id", "ref"]).where("l_seq is not null")


def _fit(d: DataFrame, task_rows: int) -> DataFrame:
    """Pass 2 over stored rows of both sides: (tenant_id, seq, l_seq) of their invoices, by islands."""
    d = _islands(d, ["tenant_id"], "cents", 100 * AMOUNT_TOLERANCE, F.floor(F.col("cents") / 100_000), "a_island")
    # A date gap only separates rows when every row of the amount island is dated.
    wide = d.groupBy("tenant_id", "a_island").agg(F.max("days").alias("widest"), F.count_if(F.col("day").isNull()).alias("undated"))
    d = d.join(wide, ["tenant_id", "a_island"])
    d = d.withColumn("at", F.when(F.col("undated") == 0, F.col("day")).otherwise(0))
    keys = ["tenant_id", "a_island", "widest"]
    d = _islands(d, keys, "at", F.col("widest"), F.floor(F.col("at") / 366), "d_island")
    stat = d.groupBy(*ISLAND).agg(
        F.count_if(F.col("side") == "i").alias("n_i"), F.count_if(F.col("side") == "l").alias("n_l"),
        (F.max("cents") - F.min("cents")).alias("span"), (F.max("day") - F.min("day")).alias("d_span"),
        F.min(F.when(F.col("side") == "i", F.col("days"))).alias("narrow"), F.max("undated").alias("undated"))
    d = d.select(*ISLAND, "side", "seq", "cents", "day", "days").join(
        stat.where("n_i > 0 and n_l > 0").select(
            *ISLAND, (F.col("n_i") + F.col("n_l")).alias("n_rows"),
            ((F.col("span") <= 100 * AMOUNT_TOLERANCE) & ((F.col("d_span") <= F.col("narrow")) & (F.col("undated") == 0))).alias("all_fit")), ISLAND)
    d = cut(d)
    whole = _by_rank(d.where("all_fit"), ISLAND)
    mixed = d.where("not all_fit")
    small = mixed.where(F.col("n_rows") <= task_rows).select(*ISLAND, "side", "seq", "cents", "day", "days").groupBy(*ISLAND).applyInPandas(
        _first_fit, "tenant_id string, seq bigint, l_seq bigint")
    fit = whole.unionByName(small)
    large = mixed.where(F.col("n_rows") > task_rows).select(*ISLAND, "side", "seq", "cents", "day", "days")
    if not large.isEmpty():
        fit = fit.unionByName(_rounds(large))
    return fit


def _paid(inv: DataFrame) -> DataFrame:
    return inv.where(F.upper("status") == "PAID")


def _cents(c: str) -> Column:
    return F.round(F.coalesce(F.col(c), F.lit(0)) * 100).cast("bigint")


def _day(c: Column | str) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def _invoice_side(paid: DataFrame, *more: Column) -> DataFrame:
    return paid.select(
        "tenant_id", F.lit("i").alias("side"), "seq", _cents("total_amount").alias("cents"), _day(F.coalesce("paid_date", "due_date")).alias("day"),
        F.when(F.col("paid_date").isNotNull(), PAID_WINDOW).otherwise(DUE_WINDOW).alias("days"), *more)


def _ledger_side(led: DataFrame, *more: Column) -> DataFrame:
    return led.where("amount > 0").select(
        "tenant_id", F.lit("l").alias("side"), "seq", _cents("amount").alias("cents"), _day(F.col("txn_date")).alias("day"), F.lit(0).alias("days"), *more)


def _left_by_reference(inv: DataFrame, led: DataFrame) -> DataFrame:
    """Rows that ``by_reference`` leaves over, both sides. Most references stand once on a side, which counts show; only
    rows of the others are ranked."""
    rows = _invoice_side(_paid(inv), F.coalesce("invoice_number", F.lit("")).alias("ref")).unionByName(_ledger_side(led, F.coalesce("reference", F.lit("")).alias("ref")))
    key, cols = ["tenant_id", "ref"], ["seq", "cents", "day", "days"]
    named = rows.where("ref <> ''")
    g = named.groupBy(*key).agg(F.count_if(F.col("side") == "i").alias("n_i"), F.count_if(F.col("side") == "l").alias("n_l"), *[F.max(c).alias(c) for c in cols])
    g = cut(g.where("n_i <> 1 or n_l <> 1"))  # one with one is a pair
    alone = g.where("n_i + n_l = 1").select("tenant_id", F.when(F.col("n_i") == 1, "i").otherwise("l").alias("side"), *cols)
    many = broadcast_if_small(g.where("n_i + n_l > 1").select(*key, F.least("n_i", "n_l").alias("n_pairs")), 1_000_000)
    ranked = number_rows(named.join(many, key), key + ["side"], {"range": seq_block()}, ["seq"], "k").where("k > n_pairs")
    plain = ["tenant_id", "side", *cols]
    return rows.where("ref = ''").select(*plain).unionByName(alone.select(*plain)).unionByName(ranked.select(*plain))


def open_counts(inv: DataFrame, led: DataFrame, task_rows: int = 20_000) -> DataFrame:
    """(tenant_id, n_open): how many paid invoices ``reconcile`` leaves without an inflow, without naming the pairs."""
    d = cut(_left_by_reference(inv, led))
    n = d.where("side = 'i'").groupBy("tenant_id").agg(F.count("*").alias("n"))
    fit = _fit(d, task_rows).where("l_seq is not null").groupBy("tenant_id").agg(F.count("*").alias("fit"))
    return n.join(fit, "tenant_id", "left").select("tenant_id", (F.col("n") - F.coalesce("fit", F.lit(0))).alias("n_open"))


def reconcile(inv: DataFrame, led: DataFrame, task_rows: int = 20_000) -> DataFrame:
    """Every paid invoice with the inflow it takes: (tenant_id, seq, invoice_number, l_seq, how)."""
    paid = _paid(inv)
    ref = by_reference(inv, led)
    i = _invoice_side(paid.join(ref, ["tenant_id", "seq"], "left_anti"))
    l = _ledger_side(led.where("amount > 0").join(ref.select("tenant_id", F.col("l_seq").alias("seq")), ["tenant_id", "seq"], "left_anti"))
    fit = _fit(cut(i.unionByName(l)), task_rows)
    pairs = ref.withColumn("how", F.lit("reference")).unionByName(fit.where("l_seq is not null").withColumn("how", F.lit("amount_date")))
    return paid.select("tenant_id", "seq", F.coalesce("invoice_number", F.lit("None")).alias("invoice_number")).join(
        pairs, ["tenant_id", "seq"], "left").withColumn("how", F.coalesce("how", F.lit("none")))
