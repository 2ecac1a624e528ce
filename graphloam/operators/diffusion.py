"""Heat-kernel and personalised PageRank diffusion, sweep cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import conductance, push_thresholds, taylor_degree
from .components import cut
from .graph import degrees


def start(seeds: DataFrame) -> DataFrame:
    """(seed, v, r): each vertex of a seed set (seed, v) has an equal share."""
    n = seeds.groupBy("seed").agg(F.count("*").alias("n"))
    return seeds.join(n, "seed").select("seed", "v", (1.0 / F.col("n")).alias("r"))


def _with_degree(edges: DataFrame) -> DataFrame:
    d = degrees(edges).select(F.col("v").alias("src"), "deg")
    return edges.select("src", "dst").join(d, "src")


def hk_vector(edges: DataFrame, seeds: DataFrame, t: float = 15.0, eps: float = 1e-4, kdd: bool = False, every: int = 4) -> DataFrame:
    """(seed, v, x): the heat-kernel push of all seed sets (seed, v) at once, a join and a sum for each level.

    Rows whose residual is under the level's threshold stop, so the frontier stays small.  What has settled is added up
    and cut with the frontier every few levels.  Seeds without an edge have no row."""
    n = taylor_degree(t, eps)
    thr = push_thresholds(n, t, eps, kdd)
    e = cut(edges.select("src", "dst"))
    deg = cut(degrees(e.withColumn("w", F.lit(1.0))).select("v", "deg"))
    r, x, fresh = start(seeds), None, []

    def settled():
        out = x
        for part in fresh:
            out = part if out is None else out.unionByName(part)
        return out.groupBy("seed", "v").agg(F.sum("x").alias("x"))

    for j in range(n):
        live = r.join(deg, "v")
        live = live if j == 0 else live.where(F.col("r") >= F.col("deg") * thr[j])
        fresh.append(live.select("seed", "v", F.col("r").alias("x")))
        r = live.join(e, live.v == e.src).groupBy("seed", F.col("dst").alias("v")).agg(F.sum(F.lit(t / (j + 1)) * F.col("r") / F.col("deg")).alias("r"))
        if j == n - 1:
            fresh.append(r.select("seed", "v", F.col("r").alias("x")))
        elif j % every == every - 1:
            r, x, fresh = cut(r), cut(settled()), []
            if r.isEmpty():
                return x
    return settled()


def ppr_vector(edges: DataFrame, seeds: DataFrame, alpha: float = 0.99, target_volume: int = 100, rounds: int | None = None, every: int = 10) -> DataFrame:
    """(seed, v, x, converged): personalised PageRank by synchronous pushes of all seed sets (seed, v).

    A vertex pushes while its residual is over eps * degree, until none is; every vertex then has at most that much left,
    as after the queue-ordered push.  A seed set from which nothing is pushed has its own shares as x.  ``rounds`` ends
    the work sooner: converged tells for each seed whether it was done."""
    eps = 1.0 / max(10 * target_volume, 100)
    deg = cut(degrees(edges).select("v", "deg"))
    # every vertex also leads to itself, so that what stays and what moves come out of one join
    own = deg.select("v", "deg", F.col("v").alias("to"), F.lit(True).alias("stays"))
    e = cut(edges.select(F.col("src").alias("v"), F.col("dst").alias("to")).join(deg, "v").select("v", "deg", "to", F.lit(False).alias("stays")).unionByName(own))
    begin = cut(start(seeds))
    over, moved = F.col("r") > eps * F.col("deg"), F.col("r") - 0.5 * eps * F.col("deg")
    r = begin.select("seed", "v", "r", F.lit(0.0).alias("x"))
    done = 0
    while True:
        for _ in range(every if rounds is None else min(every, rounds - done)):
            done += 1
            at = r.join(e, "v").where(over | F.col("stays"))
            rest = F.when(~F.col("stays"), alpha * moved / F.col("deg")).when(over, F.col("r") - moved).otherwise(F.col("r"))
            gain = F.when(F.col("stays"), F.col("x") + F.when(over, (1 - alpha) * moved).otherwise(0.0)).otherwise(0.0)
            r = at.select("seed", F.col("to").alias("v"), rest.alias("r"), gain.alias("x")).groupBy("seed", "v").agg(F.sum("r").alias("r"), F.sum("x").alias("x"))
        r = cut(r)
        open_ = cut(r.join(deg, "v").where(over).select("seed").distinct())
        if open_.isEmpty() or done == rounds:
            break
    x = r.where("x > 0").select("seed", "v", "x")
    still = begin.join(x.select("seed").distinct(), "seed", "left_anti").select("seed", "v", F.col("r").alias("x"))
    return x.unionByName(still).join(open_.withColumn("converged", F.lit(False)), "seed", "left").fillna(True, ["converged"])


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 10, every: int = 4, personal: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """(v, x): power iteration x = alpha P'x + (1-alpha) v from v, the uniform vector or the equal shares of ``personal`` (v).

    ``normalize``: x is divided by its sum."""
    e = cut(_with_degree(edges))
    v = cut(e.select(F.col("src").alias("v")).distinct())
    if personal is None:
        n = v.count()
        base = v.withColumn("b", F.lit(1.0 / max(n, 1)))
    else:
        own = personal.select("v").distinct().join(v, "v", "left_semi")
        n = own.count()
        base = v.join(own.withColumn("b", F.lit(1.0 / max(n, 1))), "v", "left").fillna(0.0, ["b"])
    base = cut(base)
    x = base.select("v", F.col("b").alias("x"))
    for k in range(rounds):
        got = x.join(e, x.v == e.src).groupBy("dst").agg(F.sum(F.col("x") / F.col("deg")).alias("s"))
        x = base.join(got, base.v == got.dst, "left").select("v", (alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * F.col("b")).alias("x"))
        if k % every == every - 1:
            x = cut(x)
    if not normalize:
        return x
    x = cut(x)
    return x.join(F.broadcast(x.agg(F.sum("x").alias("total")))).select("v", (F.col("x") / F.col("total")).alias("x"))  # one row


def dense(vector: DataFrame, vertices: DataFrame) -> DataFrame:
    """(seed, v, x) with a row for every vertex of ``vertices`` (v) and every seed of ``vector``: 0 where it has none."""
    every = F.broadcast(vector.select("seed").distinct()).join(vertices.select("v"))  # as many rows as asked for
    return every.join(vector, ["seed", "v"], "left").select("seed", "v", F.coalesce("x", F.lit(0.0)).alias("x"))


def sweep(edges: DataFrame, vector: DataFrame, digits: int = 10) -> tuple[DataFrame, DataFrame]:
    """((seed, conductance, cut, volume, support, size), (seed, v, rank)): the prefix of smallest conductance.

    Vertices are ranked by x/degree, as a share of the seed's largest x and rounded to ``digits``, then id; the first of
    equal minima counts."""
    d = degrees(edges).select("v", "deg")
    total = edges.agg(F.count("*").alias("total"))
    w = Window.partitionBy("seed").orderBy(F.desc("key"), "v")
    ranked = cut(vector.join(d, "v").withColumn("key", F.round(F.col("x") / F.greatest("deg", F.lit(1)) / F.max("x").over(Window.partitionBy("seed")), digits)).withColumn("rank", F.row_number().over(w)).select("seed", "v", "deg", "rank"))
    near = ranked.select("seed", F.col("v").alias("dst"), F.col("rank").alias("rd"))
    r = ranked.alias("r").join(edges.select("src", "dst"), F.col("r.v") == F.col("src")).join(near, ["seed", "dst"]).where("rd < rank")
    earlier = r.groupBy("seed", "v").agg(F.count("*").alias("k"))
    upto = Window.partitionBy("seed").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = ranked.join(earlier, ["seed", "v"], "left").select("seed", "v", "rank", "deg", (F.col("deg") - 2 * F.coalesce("k", F.lit(0))).alias("c"))
    sums = steps.withColumn("cut", F.sum("c").over(upto)).withColumn("volume", F.sum("deg").over(upto)).crossJoin(F.broadcast(total))  # total: one row
    scored = cut(sums.withColumn("conductance", conductance(F.col("cut"), F.col("volume"), F.col("total"))))
    best = scored.groupBy("seed").agg(F.min_by(F.struct("conductance", "cut", "volume", "rank"), F.struct("conductance", "rank")).alias("b"), F.count("*").alias("support"))
    status = best.select("seed", "b.conductance", "b.cut", "b.volume", "support", F.col("b.rank").alias("size"))
    members = ranked.join(status.select("seed", "size"), "seed").where("rank <= size").select("seed", "v", "rank")
    return status, members


#: (t, eps) of the heat kernel and target volumes of PageRank among which the best sweep is looked for.
HK_GRID = ((10.0, 1e-4), (20.0, 1e-3), (40.0, 5e-3), (80.0, 1e-2))
PPR_GRID = (100, 1000, 10_000, 100_000)


def best_of_grid(edges: DataFrame, seeds: DataFrame, grid=HK_GRID, method: str = "hk", neighbourhood: bool = False, exact: bool = False, alpha: float = 0.99) -> DataFrame:
    """(seed, param, conductance, cut, volume, support, size): of each seed the first parameters of lowest conductance.

    method: ``hk`` with a grid of (t, eps), ``ppr`` with one of target volumes (PPR_GRID).  ``neighbourhood``: every seed
    set is taken with its neighbours.  ``exact``: by the queue-ordered pushes, seed by seed, else level by level or
    synchronously over all seeds."""
    from . import seedwise

    if neighbourhood:
        near = seeds.join(edges.select(F.col("src").alias("v"), "dst"), "v").select("seed", F.col("dst").alias("v"))
        seeds = cut(near.unionByName(seeds.select("seed", "v")).distinct())
    out = None
    for k, p in enumerate(grid):
        if method == "hk":
            vector = seedwise.hk_vector_exact(edges, seeds, *p) if exact else hk_vector(edges, seeds, *p)
        else:
            vector = seedwise.ppr_vector_exact(edges, seeds, alpha, p) if exact else ppr_vector(edges, seeds, alpha, p)
        s = sweep(edges, vector.select("seed", "v", "x"))[0].withColumn("param", F.lit(k))
        out = s if out is None else out.unionByName(s)
    best = out.groupBy("seed").agg(F.min_by(F.struct("*"), F.struct("conductance", "param")).alias("b"))
    return best.select("b.seed", "b.param", "b.conductance", "b.cut", "b.volume", "b.support", "b.size")


def grow_once(edges: DataFrame, seeds: DataFrame, t: float = 20.0, eps: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Status and members, see ``sweep``, of one heat-kernel push with the usual parameters of a single run."""
    return sweep(edges, hk_vector(edges, seeds, t, eps))


def seed_report(edges: DataFrame, k: int, t: float = 15.0, eps: float = 1e-4, seed: int = 0, max_push: int | None = None) -> DataFrame:
    """(seed, degree, conductance, pushes, support, size) of ``k`` single-vertex runs from vertices drawn by a hash."""
    from . import seedwise
    from .metrics import random_seeds

    drawn = cut(random_seeds(edges, k, seed))
    vector = cut(seedwise.hk_vector_exact(edges, drawn.select(F.col("v").alias("seed"), "v"), t, eps, max_push))
    status = sweep(edges, vector.select("seed", "v", "x"))[0]
    pushes = vector.groupBy("seed").agg(F.max("pushes").alias("pushes"))
    d = degrees(edges).select(F.col("v").alias("seed"), F.col("deg").alias("degree"))
    return status.join(pushes, "seed").join(d, "seed").select("seed", "degree", "conductance", "pushes", "support", "size")


def first_hop(edges: DataFrame, seeds: DataFrame, t: float = 15.0, eps: float = 1e-4) -> DataFrame:
    """(seed, v): each seed vertex and the neighbours whose residual after its first push reaches the threshold."""
    n = taylor_degree(t, eps)
    need = F.col("du") * push_thresholds(n, t, eps)[1] if n > 1 else F.lit(0.0)
    e = _with_degree(edges).join(degrees(edges).select(F.col("v").alias("dst"), F.col("deg").alias("du")), "dst")
    near = start(seeds).join(e, F.col("v") == F.col("src")).where(t * F.col("r") / F.col("deg") >= need)
    return near.select("seed", F.col("dst").alias("v")).unionByName(seeds.select("seed", "v")).distinct()


def detect_hk(edges: DataFrame, t: float = 15.0, eps: float = 1e-4, seeds: DataFrame | None = None, compat: bool = False, ordered: bool = False) -> DataFrame:
    """(comm_id, member): best sweep sets of all seeds (by default each vertex), without those that others contain.

    ``compat``: in place of the best sweep set the whole support of one push from each seed, see ``first_hop``.
    ``ordered``: the sets are folded in the order of seeds, each into the first that holds it or that it holds, which can
    keep some that a later set holds."""
    from .merge import maximal, ordered_fold

    if seeds is None:
        seeds = edges.select(F.col("src").alias("seed"), F.col("src").alias("v")).distinct()
    members = first_hop(edges, seeds, t, eps) if compat else sweep(edges, hk_vector(edges, seeds, t, eps))[1]
    if ordered:
        return ordered_fold(members.groupBy(F.col("seed").alias("pos")).agg(F.array_sort(F.collect_set("v")).alias("m")))
    return maximal(cut(members.select(F.col("seed").alias("comm_id"), F.col("v").alias("member"))))
