"""Connected components, and tables that cut a lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STASHED: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; on a local master without it a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='auditlake-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written there outlives lost executors and is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    _STASHED.append((spark, path))
    return path


def stash(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstash(df: DataFrame) -> None:
    """Delete what stash() wrote for df, which nothing may read any more."""
    _delete(df.sparkSession, df._stashed_at)
    _STASHED[:] = [x for x in _STASHED if x[1] != df._stashed_at]


def _drop_stashed() -> None:
    for spark, path in _STASHED:
        try:
            _delete(spark, path)
        except Exception:  # the JVM is gone; the cluster cleans its checkpoint folder
            return


atexit.register(_drop_stashed)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list by alternating large and small stars.

    edges: any two columns of one orderable type. Returns (node, root), root being the smallest node reachable; nodes without
    an edge to another node are absent. Each round is one shuffle-bounded job whose result is stashed; rounds grow with the
    logarithm of the size, not with the diameter, and end when the edges stand still.
    """
    u, v = edges.columns[:2]
    a, b = F.col(u), F.col(v)
    e = stash(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = mark(e)
    while was[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        e = stash(small.unionAll(low.select(F.col("m").alias("a"), F.col("b"))).distinct())
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
