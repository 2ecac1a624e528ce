"""Connected components by alternating large and small stars, and checkpoints for loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """This session's folder in the cluster's ``spark.checkpoint.dir``.

    Without that setting a local session, which has no other machines, gets a temporary folder; on a cluster it is an
    error."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir
    if not found().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return found().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to ``checkpoint_folder`` and go on from there.

    Folders of checkpoints that nothing refers to any more are removed if the session was started with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, comp) of every vertex of ``edges``: comp is the smallest vertex that it reaches."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("p")).distinct())
    if now.isEmpty():
        return ends.select("v", F.col("v").alias("comp"))
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("p").alias("u"), F.col("u").alias("p")))
        low = both.groupBy("u").agg(F.min("p").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("p > u").select(F.col("p").alias("u"), F.col("m").alias("p")).distinct()
        least = large.groupBy("u").agg(F.min("p").alias("m"))
        small = large.join(least, "u").select(F.col("p").alias("u"), F.col("m").alias("p")).unionByName(least.withColumnRenamed("m", "p"))
        now = cut(small.where("u <> p").distinct())
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "p").cast("decimal(38,0)"))).first())
        if seen == mark:
            return ends.join(now, ends.v == now.u, "left").select("v", F.coalesce("p", "v").alias("comp"))
        mark = seen
    raise RuntimeError("components did not settle")


def community_components(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(comm_id, member, comp): components of the sub-graph that each community induces; comp is a smallest member."""
    a, b = cover.select("comm_id", F.col("member").alias("src")), cover.select("comm_id", F.col("member").alias("dst"))
    inner = edges.select("src", "dst").join(a, "src").join(b, ["comm_id", "dst"])
    node = lambda v: F.struct("comm_id", F.col(v).alias("v"))
    comp = components(inner.select(node("src").alias("src"), node("dst").alias("dst")))
    named = comp.select(F.col("v.comm_id").alias("comm_id"), F.col("v.v").alias("member"), F.col("comp.v").alias("comp"))
    return cover.join(named, ["comm_id", "member"], "left").select("comm_id", "member", F.coalesce("comp", "member").alias("comp"))
