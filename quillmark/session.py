"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | None = None, shuffle_partitions: int | None = None,
              app: str = "quillmark") -> SparkSession:
    """Local session used by tests and bench.  On a cluster the session comes from the
    launcher and none of this applies."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QM_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and is read as-is; unset it is an error
    there.  Only a local master gets a scratch folder, made once per session; the
    deployment (or the session's end, for checkpoints) cleans what is written.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="qm-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not (spark.sparkContext.getCheckpointDir() or "").startswith(d if ":" in d else f"file:{d}"):
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: its lineage
    ends there, as with ``cut_lineage``, without computing it a second time."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give row-heavy work enough tasks.

    For table scans only: counting the partitions of a scan plans it and runs nothing,
    while a join would run.  A large input already scans in many splits and is returned
    unchanged (no extra shuffle).  A table that arrives in fewer partitions than the
    cluster has cores (e.g. one Parquet file with one row group) is hash-partitioned on
    ``keys``.
    """
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    if keys:
        return df.repartition(target, *keys)
    return df.repartition(target)


def spread_rows(df: DataFrame, key: str, rows: int = 5000) -> DataFrame:
    """A stored table with at least one partition to ``rows`` rows, as far as the cluster has
    cores: narrow rows come out of a join in few partitions, whatever an iterative fit
    does with each.  Smaller tables are returned unchanged."""
    parts = min(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    if df.rdd.getNumPartitions() >= parts:
        return df
    return df.repartition(parts, key).sortWithinPartitions(key)  # sums in the same order again
