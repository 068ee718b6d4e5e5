"""What several corpus operators need: scratch tables and connected components."""

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.session import discard


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors share.

    It lies in spark.checkpoint.dir; a session without that setting uses the
    warehouse, which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table once and go on from the copy: lineage is cut, what each task
    numbered or hashed stays fixed, and a lost executor costs a re-read only."""
    folder = scratch_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def release(*tables: DataFrame) -> None:
    """Remove tables made by :func:`stored` that nothing reads any more."""
    for table in tables:
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if "/llm-" in folder:
                discard(table.sparkSession, folder)


def let_go(table: DataFrame) -> None:
    """Have Spark remove the shuffle files of steps that are over. It does so when the
    driver collects its garbage, which many steps in a row may not bring about."""
    gc.collect()
    table.sparkSession._jvm.System.gc()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """Smallest reachable node of every node that has a link.

    links: (a long, b long), no nulls; repeated and reversed rows and a = b do no
    harm. Returns (node, component), one row per node that occurs in a link.

    Alternates two steps until nothing moves. First every node sends its larger
    neighbours to its smallest one, then every node sends its smaller neighbours
    there. The work of a round is linear in the links; a node that holds a third
    of them is a minimum found per task and a join whose large side can be split.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .where("u < v")
        .distinct(),
        label,
    )
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b"))).distinct()

    def state(table: DataFrame) -> tuple:
        return tuple(
            table.agg(
                F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
            ).first()
        )

    known = state(edges)
    while True:
        # u < v in every row. Large step: look at both directions.
        both = edges.select(F.col("v").alias("n"), F.col("u").alias("m")).union(
            edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
        )
        low = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        large = (
            both.where("m > n")
            .join(low, "n")
            .select(F.col("m").alias("v"), F.col("low").alias("u"))
            .distinct()
        )
        # Small step: only the smaller neighbours of each node, itself included.
        least = large.groupBy("v").agg(F.min("u").alias("low"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array("v", "u")).alias("v"), F.col("low").alias("u"))
            .where("u < v")
            .distinct()
        )
        before, edges = edges, stored(small, label)
        release(before)
        now = state(edges)
        if now == known:
            break
        known = now
    return nodes.join(edges.withColumnRenamed("v", "node"), "node", "left").select(
        "node", F.coalesce("u", "node").alias("component")
    )
