"""Lineage cuts and connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoints' folder in spark.checkpoint.dir; where that is unset (tests on one machine), in a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(a, root) of every vertex of edges (a, b) that is not the smallest of its component.

    Each round hangs vertices on the smallest of their neighbours and shortens the paths; minima are
    aggregated before they are shuffled.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        # neighbours above a vertex move to its minimum, and so does the vertex
        moved = both.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = moved.groupBy("a").agg(F.min("b").alias("m"))
        links = cut(moved.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b")).where("a > b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select("a", F.col("b").alias("root"))
        before = now
