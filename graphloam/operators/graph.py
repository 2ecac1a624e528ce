"""Graph construction, projection and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import cut


def symmetrize(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """Both directions of every edge, self loops dropped; ``distinct``: each once, with the smallest of its weights."""
    e = edges.where("src <> dst")
    both = e.select("src", "dst", "w").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.min("w").alias("w")) if distinct else both


def undirected(edges: DataFrame, pos: str, last: bool = False) -> DataFrame:
    """Both directions of simple edges; of copies in either direction the first by ``pos`` counts, or the last.

    Of copies at one ``pos`` the smallest weight is the first and the largest the last."""
    pick = F.max_by if last else F.min_by
    one = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(pick("w", F.struct(pos, "w")).alias("w"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def encode_sorted(edges: DataFrame) -> DataFrame:
    """(idx, name): vertices numbered from 0 by name.

    Ranks are local to range partitions plus the sizes of those before, so no single task sorts all names."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return number(names, "name")


def number(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with idx from 0 in the order of ``key`` (distinct values).

    Range partitions are sorted and written once with each row's place in its partition, so that sizes and places come
    from the same partitions whatever is planned later; no single task sorts all rows."""
    parts = cut(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = parts.groupBy(part.alias("__p")).count()  # a row for each partition
    before = sizes.select("__p", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return parts.join(F.broadcast(before), part == F.col("__p")).withColumn("idx", place + F.col("__b")).drop("__p", "__b", "__id")


def encode_first(edges: DataFrame, pos: str) -> DataFrame:
    """(idx, name): vertices numbered from 0 by first appearance in the order of ``pos``, src before dst."""
    ends = edges.select(F.explode(F.array(F.struct((F.col(pos) * 2).alias("p"), F.col("src").alias("name")), F.struct((F.col(pos) * 2 + 1).alias("p"), F.col("dst").alias("name")))).alias("x"))
    firsts = ends.groupBy("x.name").agg(F.min("x.p").alias("p")).withColumn("key", F.struct("p", "name"))
    return number(firsts, "key").select("idx", "name")


def decode(cover: DataFrame, names: DataFrame) -> DataFrame:
    """(comm_id, member) with names for indices."""
    return cover.join(names, cover.member == names.idx).select("comm_id", F.col("name").alias("member"))


def encode_network(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, w) with indices of ``names`` (idx, name) for names."""
    e = edges.join(names.select(F.col("name").alias("src"), F.col("idx").alias("__s")), "src")
    return e.join(names.select(F.col("name").alias("dst"), F.col("idx").alias("__d")), "dst").select(F.col("__s").alias("src"), F.col("__d").alias("dst"), "w")


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(v, dst, w) of the vertices ``of`` (v); one without neighbours has a null."""
    return of.join(edges, of.v == edges.src, "left").select("v", "dst", "w")


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(v, deg, strength); with ``vertices`` (v) isolated ones are 0."""
    d = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"), F.sum("w").alias("strength"))
    return d if vertices is None else vertices.join(d, "v", "left").fillna({"deg": 0, "strength": 0.0})


def edges_in(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) that are edges in either direction."""
    e = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    return pairs.join(e, (F.least("a", "b") == e.x) & (F.greatest("a", "b") == e.y), "left_semi")


def remove_edges(edges: DataFrame, pairs: DataFrame, directed: bool = False) -> DataFrame:
    """``edges`` without ``pairs`` (a, b), in both directions unless ``directed``."""
    gone = pairs if directed else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.join(gone, (edges.src == gone.a) & (edges.dst == gone.b), "left_anti")


def normalize_rows(edges: DataFrame) -> DataFrame:
    """w over the sum of its row; a row whose sum is 0 stays 0."""
    s = edges.groupBy(F.col("src").alias("s")).agg(F.sum("w").alias("t"))
    return edges.join(s, edges.src == s.s).select("src", "dst", F.when(F.col("t") == 0, 0.0).otherwise(F.col("w") / F.col("t")).alias("w"))


def snapshot_vertices(steps: DataFrame) -> DataFrame:
    """(v, n_steps, first_step) over edges with a column ``step``."""
    return steps.select("step", F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.countDistinct("step").alias("n_steps"), F.min("step").alias("first_step"))


def snapshot(steps: DataFrame, step: int) -> DataFrame:
    """The edges of one step; a step that isn't there is an error."""
    out = steps.where(F.col("step") == step).drop("step")
    if out.isEmpty():
        raise IndexError(f"no snapshot {step}")
    return out


def ego_seeds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, v): each seed (v) with its neighbours and itself."""
    s = seeds.select(F.col("v").alias("seed"))
    return s.join(edges, s.seed == edges.src).select("seed", F.col("dst").alias("v")).unionByName(s.select("seed", F.col("seed").alias("v"))).distinct()


def ego_minus_ego(edges: DataFrame) -> DataFrame:
    """(ego, a, b) for a < b: the edges among the neighbours of each vertex, so the triangles at it.

    Each triangle is found once, from its vertex of the smallest (degree, id), then given to its three corners: the join
    has sum(min degree) rows rather than sum(degree squared)."""
    d = degrees(edges).select("v", "deg")
    e = edges.select("src", "dst").where("src <> dst").distinct()
    ranked = e.join(d.select(F.col("v").alias("src"), F.col("deg").alias("ds")), "src").join(d.select(F.col("v").alias("dst"), F.col("deg").alias("dd")), "dst")
    up = ranked.where(F.struct("ds", "src") < F.struct("dd", "dst")).select("src", "dst", F.struct("dd", "dst").alias("k"))
    x, y = up.select("src", F.col("dst").alias("b"), F.col("k").alias("kb")), up.select("src", F.col("dst").alias("c"), F.col("k").alias("kc"))
    wedge = x.join(y, "src").where("kb < kc").select(F.col("src").alias("a"), "b", "c")
    tri = wedge.join(up.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    corner = lambda i, p, q: F.struct(F.col(i).alias("ego"), F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    return tri.select(F.explode(F.array(corner("a", "b", "c"), corner("b", "a", "c"), corner("c", "a", "b"))).alias("t")).select("t.*")
