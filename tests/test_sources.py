import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tallyproof.operators import alerts as A, questions as Q, retrieval as R
from tallyproof.sources import casefiles as CF, corpus as K
from tallyproof.streaming import monitor as M
from tests_helpers import con, inv


def put(path, text):
    import os
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_case_files(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    put(f"{d}/CASE-1/receivables.json", json.dumps([{"invoice_number": "A", "total_amount": 5, "payment_terms_days": 30}, {"invoice_number": "B"}]))
    put(f"{d}/CASE-2/receivables.json", "﻿" + json.dumps({"invoice_number": "C", "invoice_date": "2025-02-30"}))
    rows = CF.read_json_cases(spark, f"{d}/*/receivables.json", CF.INVOICE)
    assert sorted((r.tenant_id, r.seq, r.invoice_number) for r in rows.collect()) == [("CASE-1", 1, "A"), ("CASE-1", 2, "B"), ("CASE-2", 1, "C")]
    assert CF.read_json_cases(spark, f"{d}/*/contracts.json", CF.INVOICE).count() == 0
    p = {r.invoice_number: r for r in CF.project(rows, CF.INVOICE_MAP).collect()}
    assert float(p["A"].total_amount) == 5 and p["C"].issue_date is None and json.loads(p["A"].raw)["invoice_number"] == "A"
    put(f"{d}/CASE-1/bank_ledger.csv", "﻿date,description,counterparty_ban,reference,amount,balance\n2025-01-01,x,,R1,\"1,200.50\",5\n2025-01-02,y,,,bad,\n")
    led = CF.read_ledger_csv(spark, f"{d}/CASE-1/bank_ledger.csv").collect()
    assert [float(r.amount) for r in led] == [1200.5, 0.0] and led[0].date == "2025-01-01" and led[1].balance is None


def test_statistics_must_be_there(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    with pytest.raises(FileNotFoundError):
        CF.read_statistics(spark, d)
    for name, _ in CF.STATISTIC_FILES.values():
        put(f"{d}/{name}", "年度,行業別,中小企業(家),全部企業(家)\n2024,甲、業,\"1,000\",2\n")
    got = {r.indicator: (r.sme, r.all_) for r in CF.read_statistics(spark, d).collect()}
    assert got["firms"] == (1000.0, 2.0) and got["employees"] == (1_000_000.0, 2000.0)
    put(f"{d}/{CF.STATISTIC_FILES['sales'][0]}", "年度,行業別,中小企業(家),全部企業(家)\n")
    with pytest.raises(ValueError):
        CF.read_statistics(spark, d)


def test_page_lines():
    html = "<html><nav><li>menu</li></nav><body><h1>Title</h1><p>one<p>two &amp; three</p><ul><li>a<p>inner</p></li><li>leaf</li></ul><script>x</script><p>o</p></body>"
    assert K._page_lines(html) == ["# Title", "one", "two & three", "inner", "leaf"]


def test_clean_text(spark):
    raw = "Page 1 of 3\nA  \n- 3 -\n=====\n```\n- 3 -\n\n\n\nx  \n```\nB\x07\n第 2 頁，共 3 頁\n\n\n\nC"
    assert spark.range(1).select(K.clean_text(F.lit(raw)).alias("x")).first().x == "A\n\n\n```\n- 3 -\n\n\n\nx  \n```\nB\n\nC"


def test_chunks(spark):
    text = "intro\n# A\n" + "。".join("句" * 30 for _ in range(60)) + "\n## B\nshort"
    rows = sorted(K.chunk(spark.createDataFrame([("s", "c", text)], "source string, category string, text string")).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert {r.headers for r in rows} == {"", "A"} or {r.headers for r in rows} == {"", "A", "A > B"}
    assert rows[0].content.startswith("[全文脈絡]") and rows[-1].content == "[A > B]\nshort"
    assert all(len(r.content) <= 400 + 20 for r in rows) and all(r.is_intact_section for r in rows if r.headers != "A")


def test_names_and_dates(spark):
    f = lambda c, s: spark.createDataFrame([(s,)], "s string").select(c.alias("x")).first().x
    assert f(K.norm_stem(F.col("s")), "4_直接信用保證要點 (1)") == "信保基金-直接信用保證要點"
    assert f(K.infer_published(F.col("s")), "承保統計11501") == "2026-01" and f(K.infer_published(F.col("s")), "年報2023x") == "2023" and f(K.infer_published(F.col("s")), "要點") is None


def stream(spark, df):
    d = tempfile.mkdtemp(prefix="spark-") + "/in"
    df.write.parquet(d)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(d)


def test_trailing_rate_stream_equals_batch(spark):
    """Files out of order, a run that ends and is taken up again, and rows later than the watermark: what is not late counts as in the batch form."""
    log = spark.sql("select id as event_id, concat('u', id % 3) as actor, 'T' as tenant_id, timestamp_seconds(1700000000 + (id * id * 37) % 4000) as ts from range(120)")
    late = spark.sql("select 500 + id as event_id, 'u0' as actor, 'T' as tenant_id, timestamp_seconds(1700000100 + id) as ts from range(20)")
    clock = spark.sql("select -1L as event_id, 'clock' as actor, 'T' as tenant_id, timestamp_seconds(1700000000 + 90000) as ts")
    again = spark.sql("select -2L as event_id, 'clock' as actor, 'T' as tenant_id, timestamp_seconds(1700000000 + 190000) as ts")
    d, dropped = tempfile.mkdtemp(prefix="spark-"), 0
    for parts in ((log.where("event_id % 2 = 0").repartition(2), log.where("event_id % 2 = 1").coalesce(1)), (clock, again.coalesce(1)), (late.coalesce(1),)):
        for part in parts:
            part.write.mode("append").parquet(f"{d}/in")
        feed = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
        dropped += M.late_rows(M.drain_to_table(M.trailing_rates(feed, 600, 4, "2 hours"), f"{d}/out", f"{d}/p", "append"))
    got = sorted((r.event_id, r.n_recent) for r in spark.read.parquet(f"{d}/out").collect())
    want = sorted((r.event_id, r.n_recent) for r in Q.rate_anomalies(log, 600, 4).collect())
    assert got == want and want and dropped >= 20


def test_alert_stream_equals_batch(spark):
    rows = inv(spark, {}, {"tenant_id": "U", "total_amount": 9}).repartition(2, "tenant_id")
    d = tempfile.mkdtemp(prefix="spark-")
    store = M.AlertStore(spark, f"{d}/store")
    today = dt.date(2025, 9, 1)
    for n in range(2):  # a second run sees nothing new
        if n == 0:
            s = stream(spark, rows)
        M.alert_stream(s, lambda: rows, lambda: con(spark), store, today, f"{d}/p")
    got = sorted((r.tenant_id, r.fingerprint) for r in store.read().collect())
    assert got == sorted((r.tenant_id, r.fingerprint) for r in A.scan(rows, con(spark), today).collect())


def test_alert_store_folds_buckets_and_writes_what_it_sees(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    store = M.AlertStore(spark, d, buckets=4, least=5)
    head = lambda keys, rule="R": spark.createDataFrame([(f"T{k}", f"f{k}", rule, "warning", 1) for k in keys], "tenant_id string, fingerprint string, rule_id string, severity string, n_evidence bigint")
    day = dt.datetime(2025, 1, 1)
    want = {}
    for batch, keys in enumerate([range(40), range(30, 45), range(3), range(60), []]):
        for again in range(2 if batch in (1, 3) else 1):  # a batch that is run again replaces itself
            store.apply(head(keys, f"R{batch}"), batch, day + dt.timedelta(days=batch))
        for k in keys:
            first = want.get(k, (f"R{batch}", day + dt.timedelta(days=batch)))
            want[k] = (*first[:2], day + dt.timedelta(days=batch))
        got = {int(r.tenant_id[1:]): (r.rule_id, r.first_seen_at, r.last_seen_at) for r in store.read().collect()}
        assert got == want, batch
    assert {r.tenant_id for r in store.read(before=1).collect()} == {f"T{k}" for k in range(40)}
    rows = lambda kind, n: spark.read.parquet(f"{d}/{kind}/n={n}").count()
    assert [rows("log", n) for n in range(5)] == [40, 15, 3, 60, 0] and 2 not in store._done("folded") and 0 in store._done("folded")
    out = f"{d}/new"
    M.drain_to_table(M.new_alerts(store.sightings(), "30 days"), out, f"{d}/p", "append")
    assert sorted(int(r.tenant_id[1:]) for r in spark.read.parquet(out).collect()) == sorted(want)


def test_document_stream_keeps_last_version(spark):
    docs = spark.sql("select 'a' as source, 'c' as category, '# H\nold text' as text, timestamp_seconds(1) as seen_at union all select 'a', 'c', '# H\nnew text', timestamp_seconds(2) union all select 'b', 'c', 'other', timestamp_seconds(1)")
    d = tempfile.mkdtemp(prefix="spark-")
    M.ingest_stream(stream(spark, docs.coalesce(1)), f"{d}/out", f"{d}/p")
    got = M.current_chunks(spark, f"{d}/out").collect()
    assert sorted((r.source, r.content) for r in got) == [("a", "[H]\nnew text"), ("b", "[全文脈絡]\nother")]
    assert {r.term for r in M.current_chunks(spark, f"{d}/out", "postings").where("source = 'a'").collect()} >= {"new", "text"}


def test_ingest_writes_a_parent_once(spark):
    text = "# H\n" + " ".join(f"word{i % 90}" for i in range(900)) + "\n# K\nshort 發票 發票"
    docs = spark.createDataFrame([("a", "c", "gone", 1), ("a", "c", text, 2), ("b", "c", "other", 1)], "source string, category string, text string, t long").selectExpr("source", "category", "text", "timestamp_seconds(t) as seen_at")
    d = tempfile.mkdtemp(prefix="spark-")
    M.ingest_stream(stream(spark, docs.coalesce(1)), f"{d}/out", f"{d}/p")
    newest = docs.where("text <> 'gone'")
    whole = K.chunk(newest)
    assert sorted(map(tuple, M.chunks_with_parents(spark, f"{d}/out").select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    chunk_id = F.struct("source", "chunk_index").alias("chunk_id")
    want = R.postings(whole.select(chunk_id, F.lit("").alias("category"), F.col("parent_content").alias("text"))).select("chunk_id.*", "term", "tf")
    assert sorted(map(tuple, M.chunk_postings(spark, f"{d}/out").collect())) == sorted(map(tuple, want.collect()))
    parents = whole.select("source", "parent_content").distinct().count()
    stored = spark.read.parquet(f"{d}/out/chunks").where("parent_content is not null").count()
    assert stored == parents < whole.count()
    assert spark.read.parquet(f"{d}/out/postings").groupBy("source", "parent_index", "term").count().where("count > 1").count() == 0


def test_published_is_no_end_of_a_longer_number(spark):
    names = {"承保統計11501": "2026-01", "a 4379167456496209": None, "card 4379201456496209": "2014", "stats 09912": "2010-12", "x11513": None, "年報2024": "2024"}
    d = spark.createDataFrame([(n,) for n in names], "stem string").select("stem", K.infer_published(F.col("stem")).alias("p"))
    assert {r.stem: r.p for r in d.collect()} == names


def test_registry_equals_its_sql_on_odd_first_lines(spark):
    import duckdb
    from tallyproof.plans import load_all
    from tallyproof.plans.registry import ORACLES, QUERIES
    load_all()
    d = tempfile.mkdtemp(prefix="spark-")
    texts = [(i, t) for i, t in enumerate(["ends 4379167456496209", "", None, "plain\nmore 11501", "in 2019 or so", "4379167456496209\n"] * 10)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    con_ = duckdb.connect()
    con_.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    for name in ("I14_registry", "I10_name_rules"):
        assert sorted(map(tuple, QUERIES[name](spark, d).collect())) == sorted(con_.execute(ORACLES[name]).fetchall()), name
