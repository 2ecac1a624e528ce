"""Graphs derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import symmetrize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations joined by order lines from a supplier's to a customer's nation, both directions; w counts lines."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    orders, customer, supplier = (table(spark, sf_dir, n) for n in ("orders", "customer", "supplier"))
    pairs = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    a, b = F.col("c_nationkey").cast("bigint"), F.col("s_nationkey").cast("bigint")
    return symmetrize(pairs.groupBy(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).agg(F.sum("n").cast("double").alias("w")))


def part_copurchase(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Parts that stand together in at least ``least`` orders, both directions."""
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    pairs = p.withColumnRenamed("l_partkey", "src").join(p.withColumnRenamed("l_partkey", "dst"), "l_orderkey").where("src < dst")
    return symmetrize(pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")).where(F.col("w") >= least))


def shared_lines(spark: SparkSession, sf_dir: str, longer: int = 20) -> DataFrame:
    """Documents linked to the first document that holds the same line of over ``longer`` characters: a star a line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.char_length("line") > longer)
    h = docs.select("doc_id", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")).distinct()
    first = h.groupBy("h", "h2").agg(F.min("doc_id").alias("src"), F.count("*").alias("n")).where("n > 1")
    star = h.join(first, ["h", "h2"]).where("doc_id <> src").select("src", F.col("doc_id").alias("dst"), F.lit(1.0).alias("w")).distinct()
    return symmetrize(star)


def region_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region, as a cover."""
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("comm_id"), F.col("n_nationkey").cast("bigint").alias("member"))


def order_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping: each nation with those it trades more with than with its average partner."""
    e = nation_trade(spark, sf_dir).withColumn("mean", F.avg("w").over(Window.partitionBy("src")))
    near = e.select(F.col("src").alias("comm_id"), F.explode(F.array("src", F.when(F.col("w") > F.col("mean"), F.col("dst")))).alias("member"))
    return near.where("member is not null").distinct()
