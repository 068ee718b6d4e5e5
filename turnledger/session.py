"""Session settings and the shared folder for intermediate tables."""

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tasks that list folders, per core.
LISTING_TASKS = 4
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options the library's results rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Transcript readers elsewhere keep the last of two equal JSON keys.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Folders are listed by so many tasks; by default by one for each folder.
    listing = LISTING_TASKS * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(listing))
    # A stream's state lies on disk, with one bounded cache for all of an executor's tasks.
    state = "spark.sql.streaming.stateStore"
    spark.conf.set(f"{state}.providerClass", STATE_STORE)
    spark.conf.set(f"{state}.rocksdb.boundedMemoryUsage", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names for
    checkpoints or, without that, the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def new_work_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/turnledger/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str) -> DataFrame:
    """Write a table once and go on from the written copy.

    Later steps then read only the columns they need, and a lost executor costs
    a re-read of files rather than a re-run of everything before them.
    """
    df.write.mode("error").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a work folder once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of steps that are over. It does so when the
    driver collects its garbage, which many steps in a row may not bring about."""
    gc.collect()
    spark._jvm.System.gc()
