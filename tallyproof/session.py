"""Session helpers: a tuned local session for tests and benches, and written intermediate tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tallyproof", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and local benches. On a cluster, bring your own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A local session that names none (unit tests, a laptop) gets a temporary folder; on a cluster that is an error, since
    executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Arrow batches stay below this size, so a task holds few long rows at a time.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has set a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b") or 0) >= (1 << 30):
        spark.conf.set(key, str(BATCH_BYTES))


_WRITTEN: dict[tuple[str, str, str], str] = {}


def written(spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame],
            cluster_by: list[str] | None = None, long_rows: bool = False) -> DataFrame:
    """Write ``build()`` once per application as Parquet in the shared folder and read it back.

    Used for ingest outputs (numbered case tables) that many jobs read. The result survives executor loss,
    has a short lineage, and gives later jobs column pruning and push-down. Rows are sorted inside each file
    by ``cluster_by`` so that row-group statistics prune on it; no exchange is added, so a hot key stays split.
    ``long_rows`` (megabytes each) keeps row groups small, since a reader may load all rows of a group at once.
    """
    app = spark.sparkContext.applicationId
    key = (app, scope, name)
    if key not in _WRITTEN:
        tag = hashlib.sha1(scope.encode()).hexdigest()[:10]
        path = f"{shared_dir(spark)}/tallyproof/{app}/{tag}/{name}"
        df = build()
        if cluster_by:
            df = df.sortWithinPartitions(*cluster_by)
        sizes = {"parquet.block.size": BATCH_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1} if long_rows else {}
        df.write.mode("overwrite").options(compression="zstd", **sizes).parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def shared_path(spark: SparkSession, scope: str, name: str) -> str:
    """A place of this application in the shared folder (written files, stream progress)."""
    tag = hashlib.sha1(scope.encode()).hexdigest()[:10]
    return f"{shared_dir(spark)}/tallyproof/{spark.sparkContext.applicationId}/{tag}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` as Parquet in the shared folder and read it back (used between rounds of iterative jobs and where a
    table is read twice). Like a reliable checkpoint it ends the lineage; stored by columns it is several times smaller."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyproof/{spark.sparkContext.applicationId}/cut/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
