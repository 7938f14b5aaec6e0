"""Industry statistics, table lookup and calibration weights.

``series``: (indicator, industry, year, sme, all_). ``cells``: (source, row, col, text). ``melted``: (source, row,
row_label, column, value, period, unit).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import broadcast_if_small
from ..functions.ordered import first_per_key

INDICATORS = ["firms", "sales", "exports", "domestic", "employees"]
# Punctuation dropped from industry names, total rows, top-level industries, name maps.
NAME_DROP = "、，,．・･ 　()（）"
TOTALS = ["總計", "合計", "小計", ""]
TOP_LEVEL = ["農、林、漁、牧業", "礦業及土石採取業", "製造業", "電力及燃氣供應業", "用水供應及污染整治業", "營造業", "批發及零售業", "運輸及倉儲業", "住宿及餐飲業",
             "出版影音及資通訊業", "金融及保險業", "不動產業", "專業、科學及技術服務業", "支援服務業", "公共行政及國防", "教育業", "醫療保健及社會工作服務業",
             "藝術、娛樂及休閒服務業", "其他服務業", "資訊及通訊傳播業"]
INDUSTRY_MAP = {
    "機械設備製造業": "精密機械", "金屬製品製造業": "精密機械", "產業用機械設備維修及安裝業": "精密機械", "電子零組件製造業": "電子零組件",
    "電腦、電子產品及光學製品製造業": "電子零組件", "食品製造業": "食品加工", "飲料製造業": "食品加工", "紡織業": "紡織成衣", "成衣及服飾品製造業": "紡織成衣",
    "機械器具批發業": "機械器具批發", "建材批發業": "建材批發", "食品、飲料及菸草製品批發業": "食品批發",
}
ORG_MAP = {"股份有限公司": "股份有限公司", "有限公司": "有限公司", "獨資或合夥": "企業社"}
EXPORT_LED, SMALL_SALES, LABOUR = 30.0, 2000, 10


def norm_name(c: Column) -> Column:
    return F.translate(F.trim(c), NAME_DROP, "")


def clean_series(raw: DataFrame) -> DataFrame:
    """Normalised names, no total rows, the last row per (indicator, industry, year)."""
    d = raw.withColumn("display", F.trim("industry")).withColumn("industry", norm_name(F.col("industry")))
    d = d.where(~F.col("industry").isin(TOTALS) & ~F.col("display").isin(TOTALS) & F.col("year").isNotNull())
    return d.groupBy("indicator", "industry", "year").agg(F.max_by(F.struct("sme", "all_", "display"), "row_no").alias("v")).select(
        "indicator", "industry", "year", "v.sme", "v.all_", "v.display")


def profiles(series: DataFrame, year: int | None = None, every_year: bool = False) -> DataFrame:
    """Shares, means and dependence per industry, for the latest year unless one, or every one, is asked for."""
    s = series
    if every_year:
        pass
    elif year is None:
        last = s.where("indicator = 'firms'").agg(F.max("year").alias("_y"))  # one row
        s = s.join(F.broadcast(last), F.col("year") == F.col("_y")).drop("_y")
    else:
        s = s.where(F.col("year") == year)
    pick = lambda k, col: F.max(F.when(F.col("indicator") == k, F.col(col)))
    g = s.groupBy("industry", "year").agg(*[pick(k, "sme").alias(k) for k in INDICATORS], pick("firms", "all_").alias("firms_all"))
    c = lambda k: F.col(k).cast("double")
    div = lambda a, b: a / F.nullif(b, F.lit(0.0))
    return g.select(
        "industry", "year", div(100 * c("firms"), c("firms_all")).alias("sme_share"), "firms", div(100 * c("sales"), c("firms")).alias("mean_sales"),
        div(100 * c("exports"), c("sales")).alias("export_share"), div(100 * c("domestic"), c("sales")).alias("domestic_share"), div(c("employees"), c("firms")).alias("mean_staff"))


def tags(prof: DataFrame) -> DataFrame:
    t = F.array_compact(F.array(
        F.when(F.col("export_share") >= EXPORT_LED, "export-led").when(F.col("export_share").isNotNull(), "domestic-led"),
        F.when(F.col("mean_sales") < SMALL_SALES, "small scale"), F.when(F.col("mean_staff") >= LABOUR, "labour-intensive")))
    return prof.select("industry", "year", t.alias("tags"))


def coverage(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Industries missing from each indicator in the latest year, and the overall rate."""
    last = series.where("indicator = 'firms'").agg(F.max("year").alias("_y"))  # one row
    s = series.join(F.broadcast(last), F.col("year") == F.col("_y")).select("indicator", "industry").distinct()
    n = s.groupBy("industry").agg(F.collect_set("indicator").alias("have"))  # at most five names
    all_ = F.array(*[F.lit(k) for k in INDICATORS])
    missing = n.select("industry", F.explode(F.array_except(all_, "have")).alias("indicator"))
    full = F.size("have") == len(INDICATORS)
    rate = n.agg(F.count("*").alias("in_any"), F.count_if(full).alias("in_all")).withColumn("rate", F.round(F.col("in_all") / F.nullif(F.col("in_any"), F.lit(0)), 4))
    return missing, rate


def header_rows(cells: DataFrame, probe: int = 10) -> DataFrame:
    """Header row per source: the first of the first ten rows with two filled cells whose next row has a number in its
    second column, else row 0."""
    top = cells.where(F.col("row") <= probe)
    number = F.regexp_replace("text", ",", "").try_cast("double")
    r = top.groupBy("source", "row").agg(F.count_if(F.trim("text") != "").alias("filled"), F.max(F.when((F.col("col") == 1) & ~F.isnan(number), number)).isNotNull().alias("numeric"))
    nxt = r.select("source", (F.col("row") - 1).alias("row"), F.col("numeric").alias("next_numeric"))
    d = r.join(nxt, ["source", "row"], "left").where((F.col("row") < probe) & (F.col("filled") >= 2) & F.col("next_numeric"))
    found = d.groupBy("source").agg(F.min("row").alias("h"))
    return cells.select("source").distinct().join(found, "source", "left").select("source", F.coalesce("h", F.lit(0)).alias("header"))


def melt(cells: DataFrame) -> DataFrame:
    """Header-offset tables as rows of (row label, column, value) with period and unit from the first six rows."""
    h = header_rows(cells)
    top = cells.where("row < 6")
    at = F.struct("row", "col")
    meta = top.groupBy("source").agg(
        F.min_by(F.trim("text"), F.when(F.rlike("text", F.lit(r"[0-9]{2,4}\s*年")), at)).alias("period"),
        F.min_by(F.trim(F.element_at(F.split("text", "[:：]"), -1)), F.when(F.contains("text", F.lit("單位")), at)).alias("unit"))
    c = cells.join(h, "source")
    names = c.where("row = header and col > 0").select("source", "col", F.trim("text").alias("column"))
    label = c.where("row > header and col = 0").select("source", "row", F.trim("text").alias("row_label")).where("row_label not in ('', 'nan', 'None')")
    body = c.where("row > header and col > 0").select("source", "row", "col", "text")
    return body.join(label, ["source", "row"]).join(names, ["source", "col"]).join(meta, "source", "left").select(
        "source", "row", "row_label", "column", F.trim("text").alias("text"), F.regexp_replace("text", ",", "").try_cast("double").alias("value"), "period", "unit")


def lookup(melted: DataFrame, keywords: DataFrame, limit: int = 12) -> DataFrame:
    """First ``limit`` rows per keyword whose label contains it, with their values. (query_id, keyword) in.

    Labels meet keywords on the substrings of the labels (3 to 30 characters and short), an equi-join.
    """
    has = melted.where(F.col("text").isNotNull() & ~F.col("text").isin("", "nan", "None", "-"))
    rows = has.select("source", "row", "row_label").distinct()
    lab = rows.select("row_label").distinct()
    n = F.length("row_label")
    subs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(F.col("row_label"), i, k)))))
    words = keywords.select("keyword").distinct()
    hit = lab.select("row_label", F.explode(subs).alias("keyword")).join(broadcast_if_small(words), "keyword")
    d = first_per_key(hit.join(rows, "row_label"), ["keyword"], ["source", "row"], limit, rank="place")
    d = d.join(has.select("source", "row", "column", "text", "value", "period", "unit"), ["source", "row"])
    return keywords.join(d, "keyword")


def describe(melted: DataFrame, sample: int = 20) -> DataFrame:
    """Per source: columns, rows, and the first 20 labels in table order."""
    g = melted.groupBy("source").agg(F.count_distinct("row").alias("row_count"), F.array_sort(F.collect_set("column")).alias("columns"), F.max("period").alias("period"), F.max("unit").alias("unit"))
    first = first_per_key(melted.select("source", "row", "row_label").distinct(), ["source"], ["row"], sample)
    labels = first.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "row_label"))), lambda s: s["row_label"]).alias("sample"))
    return g.join(labels, "source")


def distribution(rows: DataFrame, top_level: list[str] = TOP_LEVEL) -> DataFrame:
    """Weights of the leaf rows of one dimension (dimension, name, amount): total row read apart, top-level names left out."""
    from .metrics import positive_number
    v = rows.where(~F.col("name").isin("", "nan", "None") & positive_number(F.col("amount").cast("double")))
    leaf = v.where(~F.col("name").isin(["合計"] + top_level))
    sums = leaf.groupBy("dimension").agg(F.sum("amount").alias("leaf_total"))
    total = v.groupBy("dimension").agg(F.max(F.when(F.col("name") == "合計", F.col("amount"))).alias("stated"), F.sum(F.when(F.col("name") != "合計", F.col("amount"))).alias("summed"))
    d = leaf.join(sums, "dimension").join(total, "dimension")
    return d.select("dimension", "name", "amount", (F.col("amount").cast("double") / F.col("leaf_total").cast("double")).alias("weight"), F.coalesce("stated", "summed").alias("total"))


def regroup(dist: DataFrame, names: dict[str, str]) -> DataFrame:
    """Weights by mapped name, renormalised over the names the map knows."""
    m = F.create_map(*[x for kv in names.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    d = dist.withColumn("grp", F.try_element_at(m, F.col("name"))).where("grp is not null").groupBy("dimension", "grp").agg(F.sum("weight").alias("w"))
    s = d.groupBy("dimension").agg(F.sum("w").alias("s"))
    return d.join(s, "dimension").select("dimension", "grp", (F.col("w") / F.col("s")).alias("weight"))


def market_coverage(dist: DataFrame, names: list[str], top: int = 8) -> tuple[DataFrame, DataFrame]:
    """Covered and uncovered share per dimension, and the largest uncovered names."""
    inside = F.col("name").isin(names)
    r = dist.groupBy("dimension").agg(F.count_if(inside).alias("n_covered"), F.round(F.sum(F.when(inside, F.col("weight")).otherwise(0.0)), 4).alias("covered_share"),
                                      F.round(F.sum(F.when(~inside, F.col("weight")).otherwise(0.0)), 4).alias("uncovered_share"))
    return r, first_per_key(dist.where(~inside), ["dimension"], [F.desc("weight"), "name"], top, rank="place").select("dimension", "place", "name", F.round("weight", 4).alias("share"))
