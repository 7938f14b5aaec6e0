"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Each line has a hash, and each place a rolling hash over the last few line hashes. A chunk ends where the rolling hash is
smaller than that of both neighbours, so chunks have several lines, about three, and those
of a repeated passage begin and end alike wherever it stands in a document. Chunks of several lines that occur more
than once in the corpus are found by hash; those candidates are grouped by their bytes, and of equal chunks only the
first by (document, position) stays. A line of over 50 words is a passage by itself: it is always a chunk of its own and counts.

``line_runs`` needs no chunks to agree: it compares all pairs of neighbouring lines, so each run of two or more lines that
stood earlier in the corpus goes whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyproof.llm.common import stored

#: Lines in the rolling hash, and lines from which a chunk counts.
WINDOW, MIN_LINES = 2, 2
#: A line of more words is a chunk of its own, and counts.
LONG_WORDS = 50
BASE, MODULUS = 1_000_003, 2_147_483_647


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("bigint")


def long_line(line: Column, words: int = LONG_WORDS) -> Column:
    return F.size(F.split(line, " ")) > words


def chunks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, lines, ends)``: the lines of each text, and after which of them (1-based) a chunk ends."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    cut = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lines.alias("lines"))
    cut = cut.select("*", F.transform("lines", line_hash).alias("h"), F.transform("lines", lambda line: long_line(line)).alias("long"))

    def rolling(i: Column) -> Column:
        total = F.lit(0).cast("bigint")
        for back in reversed(range(window)):
            total = (total * BASE + F.coalesce(F.get("h", i - 1 - back), F.lit(0))) % MODULUS
        return total

    cut = cut.withColumn("r", F.transform(F.sequence(F.lit(1), F.size("lines")), rolling))
    low = lambda i: (F.get("r", i - 1) < F.get("r", i - 2)) & (F.get("r", i - 1) < F.get("r", i))
    inner = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (
        F.coalesce(low(i), F.lit(False)) | (i == F.size("lines")) | F.get("long", i - 1) | F.coalesce(F.get("long", i), F.lit(False))))
    return cut.select("doc_id", "lines", inner.alias("ends"))


def line_dedup(docs: DataFrame, window: int = WINDOW, min_lines: int = MIN_LINES) -> DataFrame:
    """``(doc_id, text, n_lines, n_removed_chunks, n_removed_lines)``, one row per row of ``docs``.

    ``text`` is what stays, its lines joined again; a null text counts as one empty line and stays null if nothing is
    removed. Chunks of white space alone are not removed. Equal chunks inside one document count as well: the first of
    all stays. A null ``doc_id`` sorts first; rows that repeat a ``doc_id`` are told apart by their text, and
    repeated rows lose the same chunks. The removed places of a document, never more than its lines, are the only list
    gathered.
    """
    key = [F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row")]
    base = docs.select(*key, F.col("text").cast("string").alias("text"))
    cut = chunks(base, window).select("doc_id", F.xxhash64(F.array_join("lines", "\n")).alias("row"), "lines", "ends")
    parts = F.transform("ends", lambda e, k: F.struct(
        k.alias("chunk"), F.coalesce(F.get("ends", k - 1), F.lit(0)).alias("low"), e.alias("high")))
    many = F.filter(parts, lambda p: (p["high"] - p["low"] >= min_lines) | long_line(F.get("lines", p["low"])))
    pieces = cut.select("doc_id", "row", F.explode(F.transform(many, lambda p: F.struct(
        p["low"].alias("low"), p["high"].alias("high"),
        F.array_join(F.slice("lines", p["low"] + 1, p["high"] - p["low"]), "\n").alias("body")))).alias("p"))
    pieces = pieces.select("doc_id", "row", "p.low", "p.high", "p.body").where(F.trim("body") != "").withColumn("h", F.xxhash64("body"))
    pieces = stored(pieces, "line-chunks")
    often = pieces.groupBy("h").count().where("count > 1").select("h")
    again = stored(pieces.join(often.hint("merge"), "h", "left_semi"), "line-candidates")
    first = again.groupBy("body").agg(F.min(F.struct("doc_id", "low", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("body", "first"), "line-first")
    later = again.join(first.hint("merge"), "body").where(~F.struct("doc_id", "low", "row").eqNullSafe(F.col("first")))
    gone = later.select("doc_id", "row", "low", "high").distinct().groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("row").alias("g_row"), "gone")
    both = base.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("row") == F.col("g_row")), "left")
    return finished(both)


def finished(both: DataFrame) -> DataFrame:
    """Texts and counts of rows ``(doc_id, text, gone)``; ``gone`` is null where nothing goes."""
    both = both.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    n_gone = F.coalesce(F.aggregate("gone", F.lit(0), lambda a, g: a + g["high"] - g["low"]), F.lit(0))
    return both.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(without(F.col("lines"), F.col("gone")), "\n")).alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed_chunks"), n_gone.cast("bigint").alias("n_removed_lines"))


def bodies(lines: Column) -> Column:
    """``(low, high, body)`` of each pair of neighbouring lines and each long line, without those of white space alone."""
    pairs = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda line, i: F.struct(
        i.alias("low"), (i + 2).alias("high"), F.concat(F.get(lines, i), F.lit("\n"), line).alias("body")))
    alone = F.transform(lines, lambda line, i: F.struct(i.alias("low"), (i + 1).alias("high"), line.alias("body")))
    return F.filter(F.concat(pairs, F.filter(alone, lambda p: long_line(p["body"]))), lambda p: F.trim(p["body"], F.lit(" \t\r\n")) != "")


def merged(spans: DataFrame) -> DataFrame:
    """``(doc_id, row, gone)``: spans ``(low, high)`` that touch or overlap as one, sorted; linear in the spans of a document."""
    order = Window.partitionBy("doc_id", "row").orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("fresh", F.when(before >= F.col("low"), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order))
    runs = runs.groupBy("doc_id", "row", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return runs.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("gone"))


def without(lines: Column, gone: Column) -> Column:
    """The lines outside sorted spans that do not overlap, as the stretches between them."""
    n = F.size(gone)
    end = lambda k: F.coalesce(F.get(gone, k - 1)["high"], F.lit(0))
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(lines, end(k) + 1, F.coalesce(F.get(gone, k)["low"], F.size(lines)) - end(k))))


def line_runs(docs: DataFrame) -> DataFrame:
    """Columns and rows of ``line_dedup``, by runs: a line goes if it stands in a pair of neighbouring lines that stood
    earlier in the corpus by (document, position), or is a long line that did. So of every repeated run of two or more
    lines only the first stays, whatever stands beside it, and the first of equal lines always stays. Pairs are found by hash
    and compared by bytes. ``n_removed_chunks`` counts runs of removed lines. The lists gathered are places in one
    document, at most two for each of its lines.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"), text.alias("text"))
    lined = base.select("doc_id", "row", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))  # a column: lambdas must not split again

    def beside(rows: DataFrame, places: DataFrame, name: str, how: str) -> DataFrame:
        listed = places.select(F.col("doc_id").alias("g_id"), F.col("row").alias("g_row"), name)
        return rows.join(listed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("row") == F.col("g_row")), how).drop("g_id", "g_row")

    hashes = lined.select("doc_id", "row", F.explode(F.transform(bodies(F.col("lines")), lambda p: F.struct(
        p["low"].alias("low"), p["high"].alias("high"), F.xxhash64(p["body"]).alias("h")))).alias("p")).select("doc_id", "row", "p.*")
    hashes = stored(hashes, "run-hashes")
    often = hashes.groupBy("h").count().where("count > 1").select("h")
    places = hashes.join(often.hint("merge"), "h", "left_semi").groupBy("doc_id", "row").agg(F.collect_set(F.struct("low", "high")).alias("places"))
    pieces = beside(lined, places, "places", "inner").select("doc_id", "row", F.explode(F.transform("places", lambda p: F.struct(
        p["low"].alias("low"), p["high"].alias("high"), F.array_join(F.slice("lines", p["low"] + 1, p["high"] - p["low"]), "\n").alias("body")))).alias("p"))
    pieces = stored(pieces.select("doc_id", "row", "p.*"), "run-candidates")
    first = pieces.groupBy("body").agg(F.min(F.struct("doc_id", "low", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("body", "first"), "run-first")
    later = pieces.join(first.hint("merge"), "body").where(~F.struct("doc_id", "low", "row").eqNullSafe(F.col("first")))
    gone = merged(later.select("doc_id", "row", "low", "high").distinct())
    return finished(beside(base, gone, "gone", "left"))
