"""Streaming forms of the rate check, the alert store and the document ingest. Each has a batch twin."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.joins import broadcast_if_small
from ..functions.text import tokens
from ..operators import alerts as A
from ..session import cut
from ..sources import corpus as K


# ---- X1: query rate ------------------------------------------------------------------------------------------------------

def window_rates(log: DataFrame, late: str = "10 minutes", length: str = "10 minutes", slide: str = "1 minute", limit: int = 60) -> DataFrame:
    """Sliding-window counts over the limit per (actor, case). Events later than the watermark are dropped by Spark and
    show in the progress of the query. The count is a partial aggregate, so a busy actor does not meet in one task."""
    w = log.withWatermark("ts", late).groupBy("actor", "tenant_id", F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"))
    return w.where(F.col("n") > limit).select("actor", "tenant_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _TrailingCounts(StatefulProcessor):
    """State of one (bucket of actors and cases, time slot): the events of the slot and, marked as context, those of the window length
    before it, packed as they come. A timer fires when the watermark passes the slot: then no event of it can come any more, each is counted
    among those of its actor and case, and the state leaves."""

    def __init__(self, span: int, slot: int, limit: int):
        self.span, self.slot, self.limit = span, slot, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "packed binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        packed = []
        for b in rows:
            batch = pa.RecordBatch.from_pandas(b[[f.name for f in EVENT]], EVENT, preserve_index=False)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, EVENT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch)
            packed.append((sink.getvalue().to_pybytes(),))
        self.events.appendList(packed)
        self.handle.registerTimer((int(key[1]) + 1) * self.slot // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        d = pa.concat_tables([pa.ipc.open_stream(r[0]).read_all() for r in self.events.get()]).to_pandas()
        self.events.clear()
        who, t = d.groupby(["actor", "tenant_id"], dropna=False, sort=False).ngroup().to_numpy(dtype=np.int64), d.t.to_numpy(dtype=np.int64)
        times, at = np.unique(t, return_inverse=True)
        of = who * (len(times) + 1)  # places in time, those of one actor and case after those of another
        places = np.sort(of + at)
        n = np.searchsorted(places, of + at, "right") - np.searchsorted(places, of + np.searchsorted(times, t - self.span, "left"), "left")
        hit = (n > self.limit) & d.own.to_numpy(dtype=bool)
        yield d.loc[hit, ["event_id", "actor", "tenant_id"]].assign(n_recent=n[hit])

    def close(self) -> None:
        pass


#: An event in the state; its names as text, whatever their type.
EVENT = pa.schema([("event_id", pa.string()), ("actor", pa.string()), ("tenant_id", pa.string()), ("t", pa.int64()), ("own", pa.bool_())])


def trailing_rates(log: DataFrame, window_seconds: int = 600, limit: int = 60, late: str = "10 minutes", buckets: int = 128) -> DataFrame:
    """Exact trailing count per event, boundary included, in whatever order events come, if none is later than the watermark.

    An event is counted in its time slot and, near the end of one, is context of the next slot as well, so a busy actor is
    spread over slots. Actors and cases share ``buckets`` states for each slot, since a state costs the same for one event as for thousands; each
    holds its share of a slot and a window of times. A slot is reported once the watermark has passed it. Later
    events are dropped and show in the progress of the query (``late_rows``). The state store must be RocksDB.
    """
    span, slot_len = window_seconds * 1_000_000, window_seconds * 6_000_000
    types = dict(log.dtypes)
    names = ["event_id", "actor", "tenant_id"]
    t = F.unix_micros("ts")
    slot = F.floor(t / F.lit(slot_len)).cast("bigint")
    here = lambda s, own: F.struct(s.alias("s"), F.lit(own).alias("own"))
    d = log.withWatermark("ts", late).withColumn("t", t).withColumn("slots", F.when((slot + 1) * slot_len - t <= span, F.array(here(slot, True), here(slot + 1, False))).otherwise(F.array(here(slot, True))))
    d = d.withColumn("bucket", F.pmod(F.xxhash64("actor", "tenant_id"), F.lit(buckets)))
    d = d.select(*[F.col(c).cast("string").alias(c) for c in names], "bucket", "t", "ts", F.explode("slots").alias("p")).select(*names, "bucket", "t", "ts", F.col("p.s").alias("slot"), F.col("p.own").alias("own"))
    out = d.groupBy("bucket", "slot").transformWithStateInPandas(
        _TrailingCounts(span, slot_len, limit), "event_id string, actor string, tenant_id string, n_recent bigint", "append", "EventTime")
    return out.select(*[F.col(c).cast(types[c]).alias(c) for c in names], "n_recent")


def late_rows(q: StreamingQuery) -> int:
    """Rows that a finished query dropped for being later than the watermark, copies into a next slot included."""
    return sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])


def drain_to_table(df: DataFrame, path: str, progress: str, mode: str = "update") -> StreamingQuery:
    """Run what is there and stop. Each batch writes its own folder, so a batch that is run again replaces itself."""
    def save(b: DataFrame, batch: int) -> None:
        b.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # every batch opens and commits each part of the state, rows or no rows: a part for each core
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(parts), spark.sparkContext.defaultParallelism)))
    try:
        q = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return q


# ---- X2: alert stream ------------------------------------------------------------------------------------------------------

SIGHTING = "tenant_id string, fingerprint string, rule_id string, severity string, n_evidence bigint, first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp, first_batch bigint, bucket int"


class AlertStore:
    """Alerts as a log of sightings by batch, folded into a state by key bucket now and then.

    A batch writes its own sightings and nothing else; run twice, it replaces them. When the log of a bucket has grown to the size
    of its folded state (and to ``least`` rows), that bucket alone is folded anew, so what is written stays in proportion to what was seen.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, least: int = 10_000):
        self.spark, self.path, self.buckets, self.least = spark, path, buckets, least

    def _done(self, kind: str) -> list[int]:
        """Committed batches or foldings; a folder without its mark does not count."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/n=*/_SUCCESS")
        st = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in (st or []))

    def _rows(self, kind: str, before: int | None) -> DataFrame:
        """Rows of a kind with the number ``n`` of their batch or folding."""
        done = [n for n in self._done(kind) if before is None or n < before]
        if not done:
            return self.spark.createDataFrame([], SIGHTING + ", n bigint")
        read = self.spark.read.schema(SIGHTING + ", n bigint").option("basePath", f"{self.path}/{kind}")
        return read.parquet(*[f"{self.path}/{kind}/n={n}" for n in done])

    def _parts(self, before: int | None) -> tuple[DataFrame, DataFrame]:
        """The last folding of each bucket, and the sightings after it. Foldings are told apart by bucket, a handful of rows."""
        folded = self._rows("folded", before)
        last = F.broadcast(folded.groupBy("bucket").agg(F.max("n").alias("upto")))  # at most a row for each bucket
        log = self._rows("log", before).join(last, "bucket", "left").where("n > coalesce(upto, -1)").drop("upto")
        return folded.join(last, "bucket").where("n = upto").drop("upto"), log

    @staticmethod
    def _fold(rows: DataFrame) -> DataFrame:
        first = lambda c: F.min_by(c, F.struct("first_batch", c)).alias(c)
        return rows.groupBy("tenant_id", "fingerprint", "bucket").agg(
            first("rule_id"), first("severity"), first("n_evidence"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
            F.max("resolved_at").alias("resolved_at"), F.min("first_batch").alias("first_batch"))

    def read(self, before: int | None = None) -> DataFrame:
        folded, log = self._parts(before)
        return self._fold(folded.unionByName(log)).select(*A.STORE)

    def apply(self, headers: DataFrame, batch: int, seen_at: dt.datetime) -> None:
        at = F.lit(seen_at).cast("timestamp")
        seen = headers.groupBy("tenant_id", "fingerprint").agg(F.min("rule_id").alias("rule_id"), F.min("severity").alias("severity"), F.min("n_evidence").alias("n_evidence"))
        seen = seen.select("*", at.alias("first_seen_at"), at.alias("last_seen_at"), F.lit(None).cast("timestamp").alias("resolved_at"),
                           F.lit(batch).cast("bigint").alias("first_batch"), F.pmod(F.xxhash64("tenant_id", "fingerprint"), F.lit(self.buckets)).cast("int").alias("bucket"))
        seen.write.mode("overwrite").parquet(f"{self.path}/log/n={batch}")
        self.compact(batch)

    def compact(self, batch: int) -> None:
        """Fold the buckets whose log is due, up to and with this batch."""
        folded, log = self._parts(batch + 1)
        size = log.groupBy("bucket").agg(F.count("*").alias("new")).join(folded.groupBy("bucket").agg(F.count("*").alias("old")), "bucket", "left")
        due = [r.bucket for r in size.where(F.col("new") >= F.greatest(F.lit(self.least), F.coalesce("old", F.lit(0)))).select("bucket").collect()]  # of a fixed number of buckets
        if due:
            rows = folded.unionByName(log).where(F.col("bucket").isin(due))
            self._fold(rows).repartition("bucket").write.mode("overwrite").parquet(f"{self.path}/folded/n={batch}")

    def sightings(self) -> DataFrame:
        """The log as a stream, one batch of the store after the other."""
        schema = SIGHTING + ", n bigint"
        return self.spark.readStream.schema(schema).option("basePath", f"{self.path}/log").parquet(f"{self.path}/log/n=*").withColumnRenamed("first_seen_at", "seen_at")


def alert_stream(changed: DataFrame, invoices: Callable[[], DataFrame], contracts: Callable[[], DataFrame], store: AlertStore, today: dt.date, progress: str) -> None:
    """For every batch of changed invoices: run the rules on the cases they belong to and upsert the alerts. The changed
    cases are a semi-join key set, worked out once a batch; while it is small the case tables are not shuffled to meet it."""
    def on_batch(b: DataFrame, batch: int) -> None:
        cases = broadcast_if_small(cut(b.select("tenant_id").distinct()), A.KEYS)  # read by every rule
        inv = invoices().join(cases, "tenant_id", "left_semi")
        con = contracts().join(cases, "tenant_id", "left_semi")
        store.apply(A.scan(inv, con, today), batch, dt.datetime.combine(today, dt.time()) + dt.timedelta(seconds=batch))

    q = changed.writeStream.foreachBatch(on_batch).option("checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination()


def new_alerts(headers: DataFrame, late: str = "1 day") -> DataFrame:
    """Append-only form: the first sighting of a fingerprint within the watermark."""
    return headers.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["tenant_id", "fingerprint"])


# ---- X3: document ingest -----------------------------------------------------------------------------------------------------

POSTING = "source string, parent_index int, term string, tf bigint"


def ingest_batch(docs: DataFrame) -> DataFrame:
    """Cleaned and chunked documents (source, category, text); the text of a parent stands at its first chunk."""
    return K.chunk(docs.withColumn("text", K.clean_text(F.col("text"))), parents_once=True)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for lo in range(0, len(b), 256):
            rows = [(s, n, t, k) for s, n, terms in b.iloc[lo:lo + 256].itertuples(index=False) for t, k in Counter(terms).items()]
            yield pd.DataFrame(rows, columns=["source", "parent_index", "term", "tf"])


def parent_postings(chunks: DataFrame) -> DataFrame:
    """(source, parent_index, term, tf). The terms of a parent are counted in its row, so nothing is shuffled."""
    p = chunks.where("parent_content is not null")
    return p.select("source", "parent_index", tokens(F.col("parent_content")).alias("terms")).mapInPandas(_counted, POSTING)


def _newest(b: DataFrame) -> DataFrame:
    """The last version of every source of a batch. Only texts of sources that a batch holds several times are moved."""
    again = broadcast_if_small(b.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source"))
    last = b.join(again, "source", "left_semi").groupBy("source").agg(F.max_by(F.struct("category", "text"), "seen_at").alias("d"))
    return b.join(again, "source", "left_anti").select("source", "category", "text").unionByName(last.select("source", "d.*"))


def ingest_stream(files: DataFrame, path: str, progress: str) -> None:
    """Only files that are new or changed arrive; each batch cleans, chunks and indexes its documents and writes chunks
    and postings. Reading the table takes the last batch of every source (last writer wins).

    A parent is written and indexed once, not for each of its chunks: ``parent_index`` leads from a chunk to its text and terms."""
    def on_batch(b: DataFrame, batch: int) -> None:
        put = lambda d, name: d.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}/batch={batch}")
        put(b.select("source").distinct(), "seen")
        put(ingest_batch(_newest(b)), "chunks")
        put(parent_postings(b.sparkSession.read.parquet(f"{path}/chunks/batch={batch}")), "postings")

    q = files.writeStream.foreachBatch(on_batch).option("checkpointLocation", progress).trigger(availableNow=True).start()
    q.awaitTermination()


def current_chunks(spark: SparkSession, path: str, table: str = "chunks") -> DataFrame:
    """Rows of each source's last batch; a version without chunks takes the chunks before it away."""
    d = spark.read.parquet(f"{path}/{table}")
    last = spark.read.parquet(f"{path}/seen").groupBy("source").agg(F.max("batch").alias("batch"))
    return d.join(last, ["source", "batch"], "left_semi").drop("batch")


def chunks_with_parents(spark: SparkSession, path: str) -> DataFrame:
    """Current chunks with the text of their parent at each of them."""
    c = current_chunks(spark, path)
    parents = c.where("parent_content is not null").select("source", "parent_index", "parent_content")
    return c.drop("parent_content").join(parents, ["source", "parent_index"])


def chunk_postings(spark: SparkSession, path: str) -> DataFrame:
    """(source, chunk_index, term, tf): the terms of its parent for every current chunk."""
    c = current_chunks(spark, path).select("source", "chunk_index", "parent_index")
    return c.join(current_chunks(spark, path, "postings"), ["source", "parent_index"]).select("source", "chunk_index", "term", "tf")
