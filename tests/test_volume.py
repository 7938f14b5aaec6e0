"""What a step shuffles and stores, read from its plan and its files."""

import os

import pytest
from pyspark.sql import functions as F

from tallyproof.functions import ordered
from tallyproof.operators import checks as C
from tallyproof.plans import case_checks
from tallyproof.session import cut
from tallyproof.sources import driver_tables as D

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_shuffled_once_for_a_running_total(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"), F.lit("wide").alias("wide"))
    got = ordered.number_rows(df, ["k"], {"b": ordered.seq_block("seq", 100)}, ["seq"], "n")
    # rows with their wide column leave a task once, for the windows; the join with the totals keeps how they are dealt
    ways = [line for line in plan(got).split("\n") if "Exchange hashpartitioning" in line]
    assert ways and not any("coalesce(" in line or "isnull(" in line for line in ways), ways
    assert {(r.k, r.seq): r.n for r in got.collect()} == {(i % 3, i): i // 3 + 1 for i in range(1000)}


def test_cut_stores_columns(spark):
    df = spark.range(200_000).select(F.lit("CASE-0001").alias("tenant_id"), F.lit("ARITH-01").alias("check_id"), "id")
    files = [f.removeprefix("file:") for f in cut(df).inputFiles()]
    assert sum(os.path.getsize(f) for f in files) < 200_000 * 10
    assert cut(df.where("id < 0")).count() == 0


@pytest.mark.parametrize("check,con,led", [("DATE-01", False, False), ("TERM-02", True, False), ("LEDGER-01", False, True)])
def test_only_needed_tables_are_built(spark, check, con, led):
    tables = case_checks._load(spark, SF, [check])
    assert [t is not None for t in tables] == [True, con, led]


def test_findings_without_the_other_tables_are_the_same(spark):
    inv, con, led = D.invoices(spark, SF), D.contracts(spark, SF), D.ledger(spark, SF)
    key = lambda d: sorted((r.tenant_id, r.passed, r.n_flagged, tuple(r.refs)) for r in d.collect())
    assert key(C.findings(inv, None, None, D.AS_OF, ["ARITH-01"])) == key(C.findings(inv, con, led, D.AS_OF, ["ARITH-01"]))
    with pytest.raises(ValueError):
        C.findings(inv, None, led, D.AS_OF, ["TERM-02"])


def test_repeated_buyers_lose_nothing(spark):
    rows = [("a", "x", 1, "N000001", 5.0, "d"), ("a", "x", 2, "N000002", 5.0, "d"), ("a", "y", 3, "N000003", 5.0, "d"), ("a", "x", 4, "N000003", 7.0, "e")]
    inv = spark.createDataFrame(rows, "tenant_id string, buyer_ban string, seq long, invoice_number string, total_amount double, invoice_date string")
    few = C.repeated_buyers(inv)
    assert sorted(r.seq for r in few.collect()) == [1, 2, 4]
    for step in (C.duplicate_claims, C.consecutive_runs):
        assert sorted(map(tuple, step(inv).collect())) == sorted(map(tuple, step(few).collect()))


def test_document_pairs_without_a_shuffle(spark):
    from tallyproof.operators import evaluate as V
    from tallyproof.plans import eval_queries
    got = eval_queries.V.bio_document_pairs(eval_queries.bio_documents(spark, SF))
    assert "Exchange" not in plan(got)
    words = eval_queries.bio_documents(spark, SF).where("doc_id < 50")
    tokens = words.select("doc_id", F.posexplode(F.arrays_zip("words", "tags")).alias("pos", "t")).select("doc_id", "pos", F.col("t.words").alias("word"), F.col("t.tags").alias("tag"))
    assert sorted(map(tuple, V.bio_pairs(tokens).collect())) == sorted(map(tuple, V.bio_document_pairs(words).collect()))


def test_edges_are_summed_by_business_numbers(spark):
    from tallyproof.operators import graph as G
    inv, bil = D.invoices(spark, SF), D.bills(spark, SF)
    got = G.merged_trade_edges(inv, bil)
    ways = [line for line in plan(got).split("\n") if "Exchange hashpartitioning" in line]
    assert ways and not any("src_id" in line for line in ways)
    want = G.merge_edges(G.trade_edges(inv, bil))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
