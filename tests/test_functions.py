import random

import pytest
from pyspark.sql import functions as F

from tallyproof.functions import ids, ordered, text
from tallyproof.functions.joins import salted_join


def one(spark, col, **vals):
    df = spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} string" for k in vals)) if vals else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("ban,ok", [("22099131", True), ("22099132", False), ("11111111", False), ("1234567", False), (None, False), ("2209-9131", True)])
def test_checksum(spark, ban, ok):
    assert one(spark, ids.ban_valid(F.col("b")), b=ban) is ok


def test_checksum_matches_digit_sums(spark):
    def slow(d):
        t = sum((int(c) * w) // 10 + (int(c) * w) % 10 for c, w in zip(d, ids.BAN_WEIGHTS))
        return t % 5 == 0 or (d[6] == "7" and (t + 1) % 5 == 0)
    rnd = random.Random(1)
    vals = [f"{rnd.randrange(10**8):08d}" for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in vals], "b string").select("b", ids.ban_valid(F.col("b")).alias("v")).collect()
    assert all(r.v == slow(r.b) for r in got)


def test_dates_and_numbers(spark):
    assert str(one(spark, ids.safe_date(F.col("a")), a="2024-02-03T10:00")) == "2024-02-03"
    assert one(spark, ids.safe_date(F.col("a")), a="soon") is None
    assert float(one(spark, ids.safe_number(F.col("a")), a="1,234.50")) == 1234.5
    assert str(one(spark, ids.roc_date(F.col("a")), a="115/05/13")) == "2026-05-13"
    assert one(spark, ids.roc_date(F.col("a")), a="115/13/45") is None


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_chain_equals_plain_order(spark, block):
    rnd = random.Random(block)
    rows = [("a" if rnd.random() < 0.7 else None, i, rnd.choice([None, 1, 2, 5])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    got = ordered.chain(df, ["k"], {"b": ordered.seq_block("seq", block)}, ["seq"], sums={"s": F.coalesce("v", F.lit(0))}, previous={"p": F.col("v")})
    run, prev = {}, {}
    want = {}
    for k, i, v in rows:
        run[k] = run.get(k, 0) + (v or 0)
        want[i] = (run[k], prev.get(k))
        prev[k] = v
    assert {r.seq: (r.s, r.p) for r in got.collect()} == want


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_runs_across_blocks(spark, block):
    rnd = random.Random(7)
    vals = sorted(rnd.sample(range(200), 90))
    df = spark.createDataFrame([("k", v) for v in vals], "k string, v long")
    got = {r.v: r.run for r in ordered.number_runs(df, ["k"], {"b": F.floor(F.col("v") / block)}, ["v"], "v", lambda a, b: b - a <= 1, "run").collect()}
    for a, b in zip(vals, vals[1:]):
        assert (got[a] == got[b]) == (b - a <= 1)


def test_tokens(spark):
    t = one(spark, text.tokens(F.col("q")), q="應收帳款 AB-45678901, Total 12,500.")
    assert t == ["應收", "收帳", "帳款", "ab-45678901", "total", "12,500"]
    assert one(spark, text.tokens(F.col("q")), q="一 a") == ["一", "a"]
    assert one(spark, text.query_terms(F.col("q")), q="款項 款項 (x)") == ["款項", "x"]


@pytest.mark.parametrize("s,v", [("九成", 0.9), ("百分之九十", 0.9), ("90%", 0.9), ("百分之八十五", 0.85), ("百分之十", 0.1), ("很多", None)])
def test_ratios_in_words(spark, s, v):
    got = one(spark, text.cn_ratio(F.col("s")), s=s)
    assert got == v if v is None else abs(got - v) < 1e-9


def test_largest_amount(spark):
    assert one(spark, text.largest_amount(F.col("s")), s="共 12,000 元與 NT$3,000,000萬元") == 3e10
    assert one(spark, text.largest_amount(F.col("s")), s="無") == 0.0


def test_ordered_search(spark):
    f = lambda frags, body: spark.createDataFrame([(frags, body)], "f array<string>, b string").select(text.found_in_order(F.col("f"), F.col("b")).alias("x")).first().x
    assert f(["abcd", "efgh"], "xxabcdyyefghzz")
    assert not f(["efgh", "abcd"], "xxabcdyyefghzz")
    assert not f(["aaaa", "aaaa"], "xaaaay")


def test_match_norm(spark):
    assert one(spark, text.match_norm(F.col("s")), s="ＡＢ c、「d」\n　E!") == "abcde"


def test_salted_join(spark):
    big = spark.createDataFrame([("hot", i) for i in range(100)] + [("x", 1)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("hot", 2)], "k string, v int")
    assert salted_join(big, small, ["k"], 8).count() == 200
