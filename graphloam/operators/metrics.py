"""Evaluation of covers, and seed strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import COEFFICIENTS
from .components import cut
from .graph import degrees, ego_seeds, number


def belonging(cover: DataFrame) -> DataFrame:
    """(member, n, alpha): in how many communities a vertex is, and the reciprocal."""
    return cover.groupBy("member").agg(F.count("*").alias("n")).withColumn("alpha", 1.0 / F.col("n"))


def modularity(edges: DataFrame, cover: DataFrame, coefficient: str = "max") -> DataFrame:
    """(modularity): link-belonging modularity; ordered pairs are summed and divided by the undirected edge count."""
    f = COEFFICIENTS[coefficient]
    e, cover = cut(edges.select("src", "dst").where("src <> dst").distinct()), cut(cover)
    deg = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    size = e.agg((F.count("*") / 2).alias("m")).crossJoin(deg.agg(F.count("*").alias("nv")))  # one row by one row
    a = cover.join(belonging(cover), "member").join(deg, F.col("member") == F.col("v")).select("comm_id", "member", "alpha", "d")
    x, y = a.select("comm_id", F.col("member").alias("src"), F.col("alpha").alias("ai"), F.col("d").alias("di")), a.select("comm_id", F.col("member").alias("dst"), F.col("alpha").alias("aj"), F.col("d").alias("dj"))
    pairs = e.join(x, "src").join(y, ["comm_id", "dst"]).withColumn("f", f(F.col("ai"), F.col("aj")))
    out = pairs.groupBy("comm_id", "src").agg(F.sum("f").alias("fo"))
    into = pairs.groupBy("comm_id", "dst").agg(F.sum("f").alias("fi"))
    full = pairs.join(out, ["comm_id", "src"]).join(into, ["comm_id", "dst"]).crossJoin(F.broadcast(size))
    term = F.col("f") - F.col("di") * F.col("dj") * (F.col("fo") / F.col("nv")) * (F.col("fi") / F.col("nv")) / F.col("m")
    return full.where("f > 1e-4").agg((F.sum(term) / F.max("m")).alias("modularity"))


def cover_report(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, n_communities, avg_size, avg_size_floor)."""
    e = edges.where("src < dst").select("src", "dst").distinct().agg(F.count("*").alias("n_edges"))
    v = edges.agg(F.countDistinct("src").alias("n_nodes"))
    c = cover.agg(F.countDistinct("comm_id").alias("n_communities"), F.count("*").alias("s"))
    one = v.crossJoin(e).crossJoin(c)  # three single rows
    return one.select("n_nodes", "n_edges", "n_communities", (F.col("s") / F.col("n_communities")).alias("avg_size"), F.floor(F.col("s") / F.col("n_communities")).alias("avg_size_floor"))


def full_report(edges: DataFrame, cover: DataFrame, coefficient: str = "max", lines: DataFrame | None = None) -> DataFrame:
    """``cover_report`` with the modularity, and with the run time of a result log (``lines``) if one is given."""
    one = cover_report(edges, cover).join(modularity(edges, cover, coefficient))  # one row by one row
    if lines is None:
        return one
    from ..sources import log_fields

    return one.join(log_fields(lines).select("time_ms"))


def evaluate(edges: DataFrame, truth: DataFrame, clusters) -> DataFrame:
    """(truth_id, f1, size, conductance): of each true community (truth_id, member) the best cluster of its members.

    clusters: a function of (edges, seeds (seed, v)) that gives (status, members) as ``diffusion.sweep`` does; each member
    is a seed of its own.  Of equal f1 the smallest seed counts."""
    seeds = truth.select(F.col("member").alias("seed"), F.col("member").alias("v")).distinct()
    status, members = clusters(edges, seeds)
    found = cut(members.select("seed", "v"))
    nt = truth.groupBy("truth_id").agg(F.count("*").alias("nt"))
    both = truth.withColumnRenamed("member", "seed").join(found, "seed").join(truth.select(F.col("truth_id").alias("t2"), F.col("member").alias("m2")), (F.col("v") == F.col("m2")) & (F.col("truth_id") == F.col("t2")))
    hits = both.groupBy("truth_id", "seed").agg(F.count("*").alias("k")).join(nt, "truth_id").join(status.select("seed", "size", "conductance"), "seed")
    p, r = F.col("k") / F.col("size"), F.col("k") / F.col("nt")
    scored = hits.select("truth_id", "seed", (2 * p * r / (p + r)).alias("f1"), "size", "conductance")
    best = scored.groupBy("truth_id").agg(F.max_by(F.struct("f1", "size", "conductance"), F.struct("f1", -F.col("seed"))).alias("b"))
    return best.select("truth_id", "b.f1", "b.size", "b.conductance")


def means(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: the mean of each column, as mean_<column>."""
    return rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns))


def seed_sets(edges: DataFrame, seeds: DataFrame, hood: bool = False) -> DataFrame:
    """(seed, v) for drawn seeds (v): each vertex by itself, with ``hood`` together with its neighbours."""
    return ego_seeds(edges, seeds) if hood else seeds.select(F.col("v").alias("seed"), "v").distinct()


def best_f1(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(truth_id, comm_id, precision, recall, f1): of each true community (truth_id, member) the best found one."""
    nf, nt = found.groupBy("comm_id").agg(F.count("*").alias("nf")), truth.groupBy("truth_id").agg(F.count("*").alias("nt"))
    both = found.join(truth, "member").groupBy("truth_id", "comm_id").agg(F.count("*").alias("k")).join(nf, "comm_id").join(nt, "truth_id")
    s = both.select("truth_id", "comm_id", (F.col("k") / F.col("nf")).alias("precision"), (F.col("k") / F.col("nt")).alias("recall"))
    s = s.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    best = s.groupBy("truth_id").agg(F.max_by(F.struct("*"), F.struct("f1", -F.col("comm_id"))).alias("b"))
    return best.select("b.*")


def test_communities(truth: DataFrame, min_size: int = 10, every: int = 10, most: int = 100) -> DataFrame:
    """(truth_id): every ``every``-th community of over ``min_size`` members, ``most`` at most."""
    n = truth.groupBy("truth_id").agg(F.count("*").alias("n")).where(F.col("n") > min_size)
    return number(n, "truth_id").where((F.col("idx") % every == 0) & (F.col("idx") < every * most)).select("truth_id")


def top_degree(edges: DataFrame, k: int) -> DataFrame:
    return degrees(edges).orderBy(F.desc("deg"), "v").limit(k).select("v", "deg")


def stride_by_degree(edges: DataFrame, stride: int) -> DataFrame:
    """(v, deg): every ``stride``-th vertex in the order of falling degree."""
    d = degrees(edges).select("v", "deg").withColumn("key", F.struct(-F.col("deg"), F.col("v")))
    return number(d, "key").where(F.col("idx") % stride == 0).select("v", "deg")


def random_seeds(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(v): ``k`` vertices by a hash."""
    return edges.select(F.col("src").alias("v")).distinct().orderBy(F.xxhash64(F.lit(seed), "v")).limit(k)


def quartiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(by).agg(q.alias("q")).select(by, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def small_side(cover: DataFrame, n: int) -> DataFrame:
    return cover.groupBy("comm_id").agg(F.count("*").alias("k")).select("comm_id", F.least("k", F.lit(n) - F.col("k")).alias("small_side"))


def split_and_choose(comps: DataFrame, densities: DataFrame) -> DataFrame:
    """(comm_id, comp, density, n): of each community the component of highest density, then size, then smallest id."""
    w = Window.partitionBy("comm_id").orderBy(F.desc("density"), F.desc("n"), "comp")
    return comps.join(densities, ["comm_id", "comp"]).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("comm_id", "comp", "density", "n")
