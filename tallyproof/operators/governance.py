"""Audit-chain verification, tenant scope, entitlements and isolation audit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import chain, seq_block

GENESIS = "GENESIS"
SHARED = "SHARED"


def row_hash(prev: Column, fields: list[Column]) -> Column:
    return F.sha2(F.concat(prev, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def verify_chain(log: DataFrame, fields: list[str], keys: list[str] = ["chain_id"], order: str = "id") -> DataFrame:
    """Per chain: rows, whether it is intact, and the first row that breaks it.

    A row breaks its chain when its prev_hash is not the row_hash before it (GENESIS at the start) or when its own
    hash does not follow from its fields. Rows are chained over id ranges, so one long chain is checked in parallel.
    """
    d = chain(log, keys, {"range": seq_block(order)}, [order], previous={"before": F.col("row_hash")})
    bad = (F.coalesce("before", F.lit(GENESIS)) != F.col("prev_hash")) | (row_hash(F.col("prev_hash"), [F.col(f) for f in fields]) != F.col("row_hash"))
    return d.groupBy(*keys).agg(F.count("*").alias("n_rows"), (F.count_if(bad) == 0).alias("intact"), F.min(F.when(bad, F.col(order))).alias("break_at"))


def scoped(df: DataFrame, tenant: str | None, shared: bool = False) -> DataFrame:
    """Rows a case may see: its own, plus SHARED for knowledge tables. No case set means no rows."""
    if not tenant:
        return df.where(F.lit(False))
    t = F.col("tenant_id")
    return df.where(t.isin(tenant, SHARED) if shared else t == tenant)


def effective_access(principals: DataFrame, grants: DataFrame, as_of: dt.date) -> DataFrame:
    """(user_id, tenant_id, access_level) in force: active principal, grant neither revoked nor expired. Every active
    principal reads SHARED."""
    active = principals.where("status = 'active'").select("user_id", "role")
    g = grants.where(F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of))))
    own = active.join(g, "user_id").select("user_id", "role", "tenant_id", "access_level").distinct()
    return own.unionByName(active.select("user_id", "role", F.lit(SHARED).alias("tenant_id"), F.lit("read").alias("access_level")))


def visible_rows(df: DataFrame, access: DataFrame) -> DataFrame:
    """Rows each user may see (user_id added), by an equi-join on the case."""
    return df.join(access.select("user_id", "tenant_id").distinct(), "tenant_id")


def isolation(raw: DataFrame, seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """Three-state audit per (tenant_a, tenant_b): can a session of A see rows of B?

    ``seen`` holds (viewer, tenant_id) rows as A's scoped sessions return them. Without rows of B there is nothing to
    prove (inconclusive).
    """
    n = raw.groupBy(F.col("tenant_id").alias("tenant_b")).agg(F.count("*").alias("b_rows"))
    v = seen.groupBy(F.col("viewer").alias("tenant_a"), F.col("tenant_id").alias("tenant_b")).agg(F.count("*").alias("leaked"))
    d = pairs.join(n, "tenant_b", "left").join(v, ["tenant_a", "tenant_b"], "left").na.fill(0, ["b_rows", "leaked"])
    state = F.when(F.col("b_rows") == 0, "inconclusive").when(F.col("leaked") > 0, "failed").otherwise("passed")
    return d.select("tenant_a", "tenant_b", "b_rows", "leaked", state.alias("state"))
