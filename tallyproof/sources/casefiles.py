"""Case files: JSON arrays, ledger CSV, JSON lines, statistics CSVs, award notices, loan CSV; typed load and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import ids
from ..functions.ordered import first_per_key

INVOICE = T.StructType([T.StructField(n, T.StringType()) for n in (
    "invoice_number", "invoice_date", "seller_ban", "seller_name", "buyer_ban", "buyer_name", "sales_amount", "tax_amount", "total_amount",
    "payment_terms_days", "due_date", "status", "paid_date")])

# Names of file fields in the tables.
INVOICE_MAP = {"invoice_number": "invoice_number", "buyer_name": "buyer_name", "buyer_ban": "buyer_ban", "seller_name": "seller_name", "seller_ban": "seller_ban",
               "invoice_date": "issue_date", "due_date": "due_date", "sales_amount": "amount", "tax_amount": "tax_amount", "total_amount": "total_amount",
               "payment_terms_days": "payment_terms_days", "status": "status", "paid_date": "paid_date"}
CONTRACT_MAP = {"contract_number": "contract_id", "buyer_name": "counterparty", "buyer_ban": "counterparty_ban", "effective_date": "start_date", "expiry_date": "end_date",
                "payment_terms_days": "payment_terms_days", "annual_commitment_amount": "contract_amount"}
LEDGER_MAP = {"date": "txn_date", "description": "description", "counterparty_ban": "counterparty", "amount": "amount", "balance": "balance", "reference": "ref_invoice"}
DATES = {"issue_date", "due_date", "paid_date", "start_date", "end_date", "signed_date", "txn_date"}
NUMBERS = {"amount", "tax_amount", "total_amount", "contract_amount", "balance", "payment_terms_days"}
LOAN_COLUMNS = ["BorrName", "BorrState", "NaicsCode", "NaicsDescription", "ApprovalDate", "ApprovalFiscalYear", "Term", "GrossApproval", "SBAGuaranteedApproval",
                "InitialInterestRate", "JobsSupported", "BusinessType", "LoanStatus", "GrossChargeOffAmount"]
# Indicators with file name and unit scale.
STATISTIC_FILES = {"firms": ("企業行業別家數統計.csv", 1), "sales": ("企業行業別銷售額統計.csv", 1), "exports": ("企業行業別出口額統計.csv", 1),
                   "domestic": ("企業行業別內銷額統計.csv", 1), "employees": ("企業行業別受僱人數統計.csv", 1000)}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def tenant_of(path: Column) -> Column:
    """The folder a case file lies in names its case."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def parse_json_files(files: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of JSON case files (path, content): an array gives its elements, a single object one row; ``seq`` from 1."""
    body = F.regexp_replace("content", "^﻿", "")
    arr = F.when(F.rlike(body, F.lit(r"^\s*\[")), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    rows = files.select(tenant_of(F.col("path")).alias("tenant_id"), F.posexplode(F.from_json(arr, T.ArrayType(schema))).alias("i", "r"))
    return rows.select("tenant_id", (F.col("i") + 1).cast("bigint").alias("seq"), "r.*")


def read_json_cases(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON file per case under ``path`` (a glob); no file gives an empty table. Case files are small; large loads
    come as JSON lines (``read_json_lines``), which split."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("tenant_id", T.StringType()), T.StructField("seq", T.LongType()), *schema.fields]))
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return parse_json_files(t, schema)


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ledger CSV with header, byte-order mark or not; an amount that does not parse counts as 0, a balance as NULL."""
    if not exists(spark, path):
        return spark.createDataFrame([], "date string, description string, counterparty_ban string, reference string, amount decimal(18,2), balance decimal(18,2)")
    d = spark.read.csv(path, header=True, encoding="UTF-8")
    d = d.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in d.columns])
    return d.withColumn("amount", F.coalesce(ids.safe_number(F.col("amount")), F.lit(0).cast("decimal(18,2)"))).withColumn("balance", ids.safe_number(F.col("balance")))


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, limit: int | None = None, order: str = "id") -> DataFrame:
    d = spark.read.schema(schema).json(path)
    return d.orderBy(order).limit(limit) if limit else d


def read_statistics(spark: SparkSession, folder: str, files: dict[str, tuple[str, int]] = STATISTIC_FILES) -> DataFrame:
    """Long table of the yearly statistics. A missing or empty file is an error, never a silent gap."""
    out = None
    for k, (name, scale) in files.items():
        path = f"{folder}/{name}"
        if not exists(spark, path):
            raise FileNotFoundError(f"statistics file missing: {path}")
        d = spark.read.csv(path, header=True, encoding="UTF-8")
        d = d.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in d.columns])
        if d.isEmpty():
            raise ValueError(f"statistics file empty: {path}")
        col = lambda pre: next((ids.safe_number(F.col(f"`{c}`"), "double") * scale for c in d.columns if c.startswith(pre)), F.lit(None).cast("double"))
        d = d.select(F.lit(k).alias("indicator"), F.col("行業別").alias("industry"), F.trim("年度").try_cast("int").alias("year"), col("中小企業").alias("sme"), col("全部企業").alias("all_"),
                     F.monotonically_increasing_id().alias("row_no"))
        out = d if out is None else out.unionByName(d)
    return out


def read_loans(spark: SparkSession, path: str) -> DataFrame:
    """Loan CSV cut to the columns in use, so the parser skips the others."""
    d = spark.read.csv(path, header=True, encoding="UTF-8")
    names = {c.lstrip("﻿"): c for c in d.columns}
    return d.select(*[F.col(f"`{names[c]}`").alias(c) for c in LOAN_COLUMNS if c in names])


def money_value(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"([0-9,]+)", 1), ",", "").try_cast("double")


def parse_awards(notices: DataFrame) -> DataFrame:
    """One row per winning bidder of award notices (job_number, unit_name, type, date, detail map with flattened keys)."""
    pre = r"^投標廠商:投標廠商([0-9]+):(.+)$"
    det = lambda k: F.try_element_at("detail", F.lit(k))
    announce = F.coalesce(ids.roc_date(det("已公告資料:公告日")), F.try_to_date("date", "yyyyMMdd"))
    d = notices.where(F.contains("type", F.lit("決標"))).withColumn("announced", announce).where("announced is not null")
    numbers = F.array_distinct(F.filter(F.transform(F.map_keys("detail"), lambda k: F.regexp_extract(k, pre, 1)), lambda n: n != ""))
    d = d.withColumn("n", F.explode(numbers))
    f = lambda name: F.try_element_at("detail", F.concat(F.lit("投標廠商:投標廠商"), F.col("n"), F.lit(":" + name)))
    period = F.regexp_extract_all(F.coalesce(f("履約起迄日期"), F.lit("")), F.lit(r"([0-9]{2,3}/[0-9]{1,2}/[0-9]{1,2})"), 1)
    d = d.withColumn("amount", money_value(f("決標金額"))).withColumn("ban", F.trim(F.coalesce(f("廠商代碼"), F.lit(""))))
    d = d.where((F.col("amount").isNotNull() | F.contains(F.coalesce(f("是否得標"), F.lit("")), F.lit("是"))) & (F.col("ban") != ""))
    return d.select(
        F.concat(F.lit("PCC-"), "job_number", F.lit("-"), "n").alias("invoice_number"), F.col("announced").alias("invoice_date"), F.coalesce("unit_name", det("機關資料:機關名稱")).alias("buyer_name"),
        F.col("ban").alias("seller_ban"), f("廠商名稱").alias("seller_name"), ids.ban_valid(F.col("ban")).alias("seller_ban_checksum_valid"),
        F.coalesce("amount", money_value(det("決標資料:總決標金額"))).alias("total_amount"), money_value(det("已公告資料:預算金額")).alias("budget_amount"), money_value(det("決標資料:底價金額")).alias("floor_price"),
        ids.roc_date(F.try_element_at(period, F.lit(1))).alias("contract_start"), ids.roc_date(F.try_element_at(period, F.lit(2))).alias("contract_end"))


def project(rows: DataFrame, names: dict[str, str], keep: list[str] = ["tenant_id", "seq"]) -> DataFrame:
    """Typed table columns from file fields; the row itself is kept as JSON in ``raw``."""
    cols = []
    for src, dst in names.items():
        c = F.col(src) if src in rows.columns else F.lit(None).cast("string")
        c = ids.safe_date(c) if dst in DATES else ids.safe_number(c) if dst in NUMBERS else c.cast("string")
        cols.append(c.alias(dst))
    return rows.select(*[k for k in keep if k in rows.columns], *cols, F.to_json(F.struct(*[c for c in rows.columns if c not in keep])).alias("raw"))


def first_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a key, the first per (case, key) in input order."""
    return first_per_key(rows.where(F.coalesce(F.col(key), F.lit("")) != ""), ["tenant_id", key], ["seq"])


ROWS_PER_FILE = 1_000_000


def replace_cases(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Full replace per case: only the partitions of the cases at hand are overwritten. Returns row counts per case."""
    d = first_rows(rows, key)
    slices = F.floor(F.col("seq") / ROWS_PER_FILE)  # a case is one file for each so many rows, however many tasks there are
    d.repartition("tenant_id", slices).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id").parquet(path)
    stored = rows.sparkSession.read.schema(d.schema).parquet(path)
    return stored.join(rows.select("tenant_id").distinct(), "tenant_id", "left_semi").groupBy("tenant_id").agg(F.count("*").alias("n"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def verbalise(rows: DataFrame, doc_type: str) -> DataFrame:
    """(tenant_id, seq, line): one sentence per row by document type. Lines stay rows; nothing is joined per case."""
    say = lambda fmt, *cols: F.format_string(fmt, *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in cols])
    if doc_type == "AR_INVOICE":
        line = say("- 發票 %s（%s 開立）：賣方統編 %s 開立予 %s（統編 %s），總計 NT$%s，帳期 %s 天，到期日 %s，狀態 %s。", "invoice_number", "invoice_date", "seller_ban", "buyer_name", "buyer_ban", "total_amount", "payment_terms_days", "due_date", "status")
    elif doc_type == "SALES_CONTRACT":
        line = say("- 合約 %s：%s（統編 %s），有效期間 %s 至 %s，帳期 %s 天，年度承諾 NT$%s。", "contract_number", "buyer_name", "buyer_ban", "effective_date", "expiry_date", "payment_terms_days", "annual_commitment_amount")
    elif doc_type == "AP_BILL":
        line = say("- 應付 %s：應付予 %s（統編 %s）NT$%s，到期 %s，狀態 %s。", "bill_number", "supplier_name", "supplier_ban", "amount", "due_date", "status")
    else:
        line = F.concat(F.lit("- "), F.array_join(F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in rows.columns if c not in ("tenant_id", "seq", "source_note")]), "；"))
    return rows.select("tenant_id", "seq", line.alias("line"))
