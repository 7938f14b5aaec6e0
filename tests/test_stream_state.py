import datetime as dt
import os
import tempfile

from tallyproof.plans import source_queries
from tallyproof.sources import driver_tables as D
from tallyproof.streaming import monitor as M


def test_state_has_a_part_for_each_core_and_the_setting_stays(spark):
    home = tempfile.mkdtemp(prefix="spark-")
    rows = [(i, f"a{i % 5}", "t", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(50)]
    log = spark.createDataFrame(rows, "event_id long, actor string, tenant_id string, ts timestamp")
    log.write.parquet(f"{home}/log")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        M.drain_to_table(M.window_rates(spark.readStream.schema(log.schema).parquet(f"{home}/log"), limit=0), f"{home}/out", f"{home}/progress")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    parts = [p for p in os.listdir(f"{home}/progress/state/0") if p.isdigit()]
    assert len(parts) == spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{home}/out").count() > 0


def test_change_log_names_invoices_only(spark):
    sf = "/root/testdata/sf0.001"
    source_queries.alert_store(spark, sf)
    feed = spark.read.parquet(source_queries.shared_path(spark, sf, "x2_feed"))
    assert sorted(feed.columns) == ["seq", "tenant_id"]
    assert feed.count() == 2 * D.invoices(spark, sf).count()
