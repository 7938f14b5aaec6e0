"""Case tables (invoices, contracts, ledger, bills) derived from star-schema Parquet tables.

``seq`` is the input ordinal of a row in its case; it is assigned once here and written, because many checks
depend on input order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ordered import chain, number_rows, seq_block
from ..session import written

AS_OF = dt.date(1998, 6, 1)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _padded(prefix: str, key: Column, width: int) -> Column:
    """The whole number with leading zeros, as ``printf`` writes it but by functions that are compiled."""
    n = key.cast("bigint")
    short = (n >= 0) & (n < 10 ** width)
    return F.when(short, F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))).when(n >= 0, F.concat(F.lit(prefix), n.cast("string"))).otherwise(
        F.format_string(f"{prefix}%0{width}d", n))


def _case(key: Column) -> Column:
    return _padded("CASE-", key, 4)


def _ban(key: Column, factor: int) -> Column:
    return (F.lit(20000000) + (key * factor) % 79999999).cast("string")


def _build_invoices(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    od = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    d = li.join(od, li.l_orderkey == od.o_orderkey)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_shipdate", "l_returnflag", "l_linestatus"]
    d = number_rows(d, ["l_suppkey"], {"range": seq_block("l_orderkey", 1 << 20)}, order, rows=li)
    terms = (F.when(F.col("l_partkey") % 4 == 0, 30).when(F.col("l_partkey") % 4 == 1, 60)
             .when(F.col("l_partkey") % 4 == 2, 90).otherwise(45))
    sales = F.col("l_extendedprice").cast("decimal(18,2)")
    tax = F.round(sales * F.col("l_tax").cast("decimal(4,2)"), 0)
    shipped = F.to_date("l_shipdate")
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    paid = (line == "F") & flag.isin("A", "R")
    return d.select(
        _case(F.col("l_suppkey")).alias("tenant_id"), "seq",
        F.col("o_custkey").alias("buyer_key"), F.col("l_partkey").alias("part_key"),
        _padded("AB", F.col("l_orderkey") * 10 + F.col("l_linenumber"), 8).alias("invoice_number"),
        _ban(F.col("l_suppkey"), 7919).alias("seller_ban"),
        F.when(F.col("l_orderkey") % 97 == 0, _ban(F.col("l_suppkey"), 7919)).otherwise(_ban(F.col("o_custkey"), 104729)).alias("buyer_ban"),
        _padded("Customer#", F.col("o_custkey"), 9).alias("buyer_name"),
        sales.alias("sales_amount"), tax.cast("decimal(18,2)").alias("tax_amount"),
        (sales + tax + F.when(F.col("l_quantity") > 49, 1000).otherwise(0)).cast("decimal(18,2)").alias("total_amount"),
        shipped.alias("invoice_date"), terms.alias("payment_terms_days"),
        F.date_add(shipped, terms + F.when(F.col("l_linenumber") == 7, 5).otherwise(0)).alias("due_date"),
        F.when(paid, "PAID").when(line == "F", "WRITTEN_OFF").when(flag == "N", "VOID").otherwise("PENDING").alias("status"),
        F.when(paid, F.date_add(shipped, (30 + F.col("l_partkey") % 40).cast("int"))).alias("paid_date"),
    )


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    return written(spark, sf, "invoices", lambda: _build_invoices(spark, sf), ["tenant_id", "seq"])


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        g = (invoices(spark, sf).where(F.col("buyer_key") % 3 == 0)
             .groupBy("tenant_id", "buyer_ban").agg(F.min("buyer_key").alias("k")))
        return g.select(
            "tenant_id", F.lit(1).cast("bigint").alias("seq"),
            F.concat(F.lit("CT"), F.col("buyer_ban")).alias("contract_number"), "buyer_ban",
            _padded("Customer#", F.col("k"), 9).alias("buyer_name"),
            (30 + 30 * (F.col("k") % 3)).cast("int").alias("payment_terms_days"),
            F.date_add(F.lit("1996-01-01").cast("date"), (F.col("k") % 700).cast("int")).alias("effective_date"),
            F.lit("1999-01-01").cast("date").alias("expiry_date"),
            (100000 + 1000 * (F.col("k") % 50)).cast("decimal(18,2)").alias("annual_commitment_amount"),
        )
    return written(spark, sf, "contracts", build, ["tenant_id"])


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        p = invoices(spark, sf).where((F.col("status") == "PAID") & (F.col("part_key") % 11 != 0)).select(
            "tenant_id", F.col("seq").alias("inv_seq"), F.col("paid_date").alias("txn_date"),
            F.when(F.col("part_key") % 5 == 0, "").otherwise(F.col("invoice_number")).alias("reference"),
            F.col("total_amount").alias("amount"))
        p = chain(p, ["tenant_id"], {"day": F.col("txn_date"), "range": seq_block("inv_seq")}, ["txn_date", "inv_seq"],
                  sums={"seq": F.lit(1).cast("bigint"), "run": F.col("amount")})
        return p.select("tenant_id", "seq", "txn_date", "reference", "amount",
                        (850000 + F.col("run") + F.when(F.col("seq") % 97 == 0, 500).otherwise(0)).cast("decimal(18,2)").alias("balance"))
    return written(spark, sf, "ledger", build, ["tenant_id", "seq"])


def bills(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_custkey")
    return o.select(
        _case(k % 100).alias("tenant_id"), F.col("o_orderkey").alias("seq"),
        _padded("AP", F.col("o_orderkey"), 8).alias("bill_number"),
        _ban(k % 100, 7919).alias("buyer_ban"), _ban(k, 104729).alias("supplier_ban"),
        _padded("Customer#", k, 9).alias("supplier_name"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.date_add(F.to_date("o_orderdate"), (15 + 15 * (F.col("o_orderkey") % 3)).cast("int")).alias("due_date"),
        F.when(F.col("o_orderstatus") == "F", "PAID").otherwise("PENDING").alias("status"),
    )
