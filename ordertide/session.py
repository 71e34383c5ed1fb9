"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that hold at any scale; partition counts are left to the caller
# (cluster defaults) or set small for local runs.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Parquet on disk is several times smaller than rows in memory; with the
    # default factor 1.0 a fact file just under the broadcast threshold gets
    # broadcast (collected to the driver) instead of the dimension side.
    "spark.sql.sources.fileCompressionFactor": "4",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove checkpoint files once their DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "ordertide", checkpoint_dir: str | None = None) -> SparkSession:
    """A local-mode session for tests and the bench. ``checkpoint_dir``: where
    it keeps intermediate tables, if ``spark.checkpoint.dir`` names nothing."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for k, v in _BASE_CONF.items():
        builder = builder.config(k, v)
    memory_gb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 31  # half of the machine's
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("ORDERTIDE_DRIVER_MEM", f"{max(1, min(16, memory_gb))}g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediate tables, taken from
    ``spark.checkpoint.dir`` (or set on the context by whoever made the
    session). On a cluster it must be storage that all executors share; none
    is ever invented here."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder "
            "(HDFS/S3/ABFS) so checkpoints survive executor loss")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans made within drop their shuffle files as soon as their rows are
    written; Spark else keeps them until the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def reliable_checkpoint(df):
    """Cut lineage by writing ``df`` to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df = df.select("*")  # a plan of its own, which nothing runs again
    return df.checkpoint(eager=True)


@contextmanager
def written_meanwhile(df: DataFrame, what: str) -> Iterator[DataFrame]:
    """``df`` as compressed Parquet files on the shared checkpoint folder, of
    which later plans read the columns they need; the files are deleted at the
    end, so nothing that is still to run may read them then."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    try:
        with shuffles_dropped(spark):
            df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
