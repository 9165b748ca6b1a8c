"""Session helpers: one place for configuration and for the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
TEXT_BATCH_ROWS = 1_000


def build_session(master: str, shuffle_partitions: int, app: str = "tierscore") -> SparkSession:
    """Session for local runs; a cluster brings its own through ``spark-submit``."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can see, as named by the cluster.

    Only when the session names none (tests, local runs) a temporary folder is set instead.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="tierscore-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tierscore/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Rows of a file scan over all cores when the files give fewer splits than there are cores.

    Scoring is CPU work, and a file of one row group would keep it on one core. A large table
    has more splits than cores and passes through without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def group_apart(scan: DataFrame, key: str) -> DataFrame:
    """Rows of a large file scan dealt by ``key`` before a ``groupBy`` of many small groups.

    Lines of a key lie anywhere in the file, so a partial aggregate holds nearly every row of its split: its
    memory follows the size of a file split. Dealt first, a task holds the groups of one shuffle partition.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() < cores else scan.repartition(key)


def use_session_timezone(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def use_text_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows, for tables whose rows are whole texts.

    The default of 10,000 rows holds tens of MB of texts at once, in the JVM and again in every Python worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
