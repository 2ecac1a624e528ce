"""Steps that are sequential within one seed: exact queue-ordered pushes, and how seeds are spread over tasks."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import psi, push_thresholds, taylor_degree
from .components import cut

#: Edges that a broadcast adjacency may have (24 bytes each); beyond it seeds fetch the neighbourhoods they need.
BROADCAST_EDGES = 2_000_000

Graph = dict[int, dict[int, float]]


def adjacency(src, dst, w) -> Graph:
    """vertex -> {neighbour: weight}, neighbours in id order."""
    out: Graph = defaultdict(dict)
    for a, b, x in sorted(zip(src, dst, w, strict=True)):
        out[a][b] = x
    return out


class Rows(dict):
    """A graph as sorted arrays of edges; the neighbours of a vertex become a dict when it is first looked up."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        super().__init__()
        self.src, self.dst, self.w = src, dst, w

    @classmethod
    def of(cls, edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double")).toArrow()
        src, dst, w = (e.column(k).to_numpy() for k in range(3))
        order = np.lexsort((w, dst, src))
        return src[order], dst[order], w[order]

    def __missing__(self, v: int) -> dict[int, float]:
        a, b = np.searchsorted(self.src, (v, v + 1))
        self[v] = near = dict(zip(self.dst[a:b].tolist(), self.w[a:b].tolist(), strict=True))
        return near

    def get(self, v: int, default=None) -> dict[int, float]:
        return self[v]


def by_seed(edges: DataFrame, seeds: DataFrame, work: Callable[[Graph, list[int]], list[tuple]], fields: str, broadcast_edges: int | None = None) -> DataFrame:
    """(seed, *fields): the rows that ``work(graph, members)`` gives for each seed set of ``seeds`` (seed, member).

    The adjacency is broadcast as sorted arrays if its edges are counted to be at most ``broadcast_edges``.  Beyond that
    seeds fetch the neighbourhoods that their work looks at, see ``_by_request``; ``work`` sees the same neighbours either
    way, and must look vertices up by ``graph[v]`` or ``graph.get(v)`` only.  Members without an edge have no neighbours.
    """
    most = BROADCAST_EDGES if broadcast_edges is None else broadcast_edges
    kind = f"seed long, {fields}"
    names = ["seed", *(f.split()[0] for f in fields.split(","))]
    if edges.limit(most + 1).count() <= most:
        sent = edges.sparkSession.sparkContext.broadcast(Rows.of(edges))

        def run(batches):
            graph = Rows(*sent.value)
            for pdf in batches:
                rows = [(s, *row) for s, m in zip(pdf.seed, pdf.m, strict=True) for row in work(graph, m.tolist())]
                yield pd.DataFrame(rows, columns=names)

        return seeds.groupBy("seed").agg(F.array_sort(F.collect_set("member")).alias("m")).repartition("seed").mapInPandas(run, kind)
    return _by_request(edges, seeds, work, fields)


class Local(dict):
    """The part of a graph that a seed has fetched; a vertex that is asked for and not there is noted in ``wanted``.

    Until it is fetched it stands as a vertex whose one neighbour, without weight, is itself, so that a run goes on and
    finds what else it will ask for.  ``SPARE`` lookups after the first such vertex end the run."""

    SPARE = 20_000

    def __init__(self, known: Graph):
        super().__init__(known)
        self.wanted: set[int] = set()
        self.spare = self.SPARE

    def __missing__(self, v: int) -> dict[int, float]:
        self.wanted.add(v)
        return {v: 0.0}

    def __getitem__(self, v: int) -> dict[int, float]:
        if self.wanted:
            self.spare -= 1
            if self.spare < 0:
                raise Unfinished
        return super().__getitem__(v)

    def get(self, v: int, default=None) -> dict[int, float]:
        return self[v]


class Unfinished(Exception):
    """A run has asked for more than it had."""


#: What a row of a seed's state is: a member of its set, an edge it has fetched, or a vertex found to have none.
MEMBER, EDGE, ALONE = range(3)


def _by_request(edges: DataFrame, seeds: DataFrame, work: Callable[[Graph, list[int]], list[tuple]], fields: str) -> DataFrame:
    """``by_seed`` for graphs of any size: each seed fetches the neighbourhoods that its work looks at, in rounds.

    A round joins the requests of all unfinished seeds with the edges and runs each seed on what it has; a run that asks
    for nothing new has seen all it needs, and its result stands.  A task holds one seed's fetched neighbourhoods.
    """
    names = [f.split()[0] for f in fields.split(",")]
    blank = (None,) * len(names)
    out_names = ["seed", "want", *names]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        seed = int(pdf.seed.iloc[0])
        own, near, alone = (pdf[pdf.kind == k] for k in (MEMBER, EDGE, ALONE))
        known = {v: {} for v in alone.a.tolist()}
        known |= adjacency(near.a.tolist(), near.b.tolist(), near.w.tolist())
        graph, rows = Local(known), []
        try:
            rows = work(graph, sorted(set(own.a.tolist())))
        except Unfinished:
            pass
        if graph.wanted:
            found = [(seed, v, *blank) for v in sorted(graph.wanted)]
        else:
            found = [(seed, None, *row) for row in rows]
        return pd.DataFrame(found, columns=out_names, dtype=object)

    zero = F.lit(0).cast("long")
    own = cut(seeds.where("member is not null").select("seed", F.lit(MEMBER).alias("kind"), F.col("member").alias("a"), zero.alias("b"), F.lit(0.0).alias("w")).distinct())
    e = edges.select(F.col("src").alias("s"), F.col("dst").alias("b"), "w")
    state, ask, done = own, own.select("seed", "a"), None
    while True:
        kind = F.when(F.col("s").isNull(), ALONE).otherwise(EDGE)
        got = ask.join(e, ask.a == e.s, "left").select("seed", kind.alias("kind"), "a", F.coalesce("b", zero).alias("b"), F.coalesce("w", F.lit(0.0)).alias("w"))
        state = cut(state.unionByName(got))
        ran = cut(state.groupBy("seed").applyInPandas(grow, f"seed long, want long, {fields}"))
        result = ran.where("want is null").select("seed", *names)
        done = result if done is None else done.unionByName(result)
        ask = ran.where("want is not null").select("seed", F.col("want").alias("a"))
        if ask.isEmpty():
            return done
        state = state.join(ask.select("seed").distinct(), "seed", "left_semi")


def hk_push(graph: Graph, seeds: dict[int, float], t: float = 15.0, eps: float = 1e-4, max_push: int | None = None, kdd: bool = False) -> tuple[dict[int, float], int]:
    """(vector, pushes) of the heat-kernel push in queue order.

    A vertex joins the next level's queue when its residual there crosses the level's threshold.  A push counts as many
    as the vertex has neighbours; the count is looked at before each push and ends the work from ``max_push`` on (None:
    never).  Members without an edge hold no mass; without any push the vector is that of the seeds.
    """
    n = taylor_degree(t, eps)
    bar = push_thresholds(n, t, eps, kdd)
    x: dict[int, float] = defaultdict(float)
    now, pushes = {v: m for v, m in seeds.items() if graph.get(v)}, 0
    queue = list(now)
    for level in range(n):
        after: dict[int, float] = defaultdict(float)
        ahead = []
        for v in queue:
            if max_push is not None and pushes >= max_push:
                return dict(x) or dict(seeds), pushes
            mass, near = now[v], graph[v]
            x[v] += mass
            share = t * mass / ((level + 1) * len(near))
            pushes += len(near)
            for u in near:
                if level == n - 1:
                    x[u] += share
                    continue
                was = after[u]
                after[u] = was + share
                need = len(graph[u]) * bar[level + 1]
                if was < need <= after[u]:
                    ahead.append(u)
        now, queue = after, ahead
    return dict(x) or dict(seeds), pushes


def exponential_column(graph: Graph, seed: int, eps: float = 0.000917, terms: int = 6) -> dict[int, float]:
    """Column ``seed`` of exp(P), P the transition matrix, by Gauss-Seidel relaxation over a level-ordered queue.

    The tolerance of a level is its push threshold shared among the entries that wait there; smaller entries are left.
    The work ends when the weighted residual falls under ``eps``.  A seed without an edge gives itself only.
    """
    if not graph.get(seed):
        return {seed: 1.0}
    weight, bar = psi(terms, 1.0), push_thresholds(terms, 1.0, eps)
    x: dict[int, float] = defaultdict(float)
    waiting, rest = {seed: 1.0}, weight[0]
    for level in range(terms):
        after: dict[int, float] = defaultdict(float)
        least = bar[level] / len(waiting)
        for v, mass in waiting.items():
            if mass < least:
                continue
            x[v] += mass
            rest -= mass * weight[level]
            share = mass / ((level + 1) * len(graph[v]))
            for u in graph[v]:
                if level == terms - 1:
                    x[u] += share
                else:
                    after[u] += share
                    rest += share * weight[level + 1]
            if rest < eps:
                return dict(x)
        if not after:
            break
        waiting = after
    return dict(x)


def lazy_push(graph: Graph, seeds: dict[int, float], alpha: float = 0.99, tolerance: float = 1e-4) -> tuple[dict[int, float], int]:
    """(vector, steps): pushes of the lazy walk: of a residual (1 - alpha) settles, half of the rest stays, half moves on.

    A vertex pushes while its residual is at least tolerance * degree; without any push the vector is the seeds'."""
    r, p, steps = dict(seeds), {}, 0
    queue = deque(v for v in sorted(seeds) if graph.get(v) and r[v] >= tolerance * len(graph[v]))
    while queue:
        v = queue.popleft()
        near, mass = graph[v], r[v]
        p[v] = p.get(v, 0.0) + (1 - alpha) * mass
        r[v] = alpha * mass / 2
        steps += 1
        share = alpha * mass / (2 * len(near))
        for u in near:
            was = r.get(u, 0.0)
            r[u] = was + share
            if u != v and was < tolerance * len(graph[u]) <= r[u]:
                queue.append(u)
        if r[v] >= tolerance * len(near):
            queue.append(v)
    return (p or r), steps


def ppr_push(graph: Graph, seeds: dict[int, float], alpha: float = 0.99, target_volume: int = 100) -> tuple[dict[int, float], int]:
    """(vector, steps): the queue-ordered personalised PageRank push; without any push the vector is the seeds'."""
    eps = 1.0 / max(10 * target_volume, 100)
    r, p = dict(seeds), {}
    queue = deque(v for v in sorted(seeds) if graph.get(v) and r[v] > eps * len(graph[v]))
    steps, most = 0, 1 / (eps * (1 - alpha))
    while queue and steps < most:
        u = queue.popleft()
        d = len(graph[u])
        moved = r[u] - 0.5 * eps * d
        r[u] = 0.5 * eps * d
        p[u] = p.get(u, 0.0) + (1 - alpha) * moved
        steps += 1
        for v in graph[u]:
            was = r.get(v, 0.0)
            r[v] = was + alpha * moved / d
            if was <= eps * len(graph[v]) < r[v]:
                queue.append(v)
    return (p or r), steps


def _equal(members: list[int]) -> dict[int, float]:
    return dict.fromkeys(members, 1.0 / len(members))


def _sets(seeds: DataFrame) -> DataFrame:
    return seeds.select("seed", F.col("v").alias("member"))


def hk_vector_exact(edges: DataFrame, seeds: DataFrame, t: float = 15.0, eps: float = 1e-4, max_push: int | None = None, kdd: bool = False) -> DataFrame:
    """(seed, v, x, pushes): ``hk_push`` of every seed set (seed, v); with a budget the order of pushes is by id."""

    def work(graph, members):
        x, pushes = hk_push(graph, _equal(members), t, eps, max_push, kdd)
        return [(v, m, pushes) for v, m in x.items()]

    return by_seed(edges, _sets(seeds), work, "v long, x double, pushes long")


def ppr_vector_exact(edges: DataFrame, seeds: DataFrame, alpha: float = 0.99, target_volume: int = 100) -> DataFrame:
    """(seed, v, x, steps): ``ppr_push`` of every seed set (seed, v)."""

    def work(graph, members):
        x, steps = ppr_push(graph, _equal(members), alpha, target_volume)
        return [(v, m, steps) for v, m in x.items()]

    return by_seed(edges, _sets(seeds), work, "v long, x double, steps long")


def lazy_vector_exact(edges: DataFrame, seeds: DataFrame, alpha: float = 0.99, tolerance: float = 1e-4) -> DataFrame:
    """(seed, v, x, steps): ``lazy_push`` of every seed set (seed, v)."""

    def work(graph, members):
        x, steps = lazy_push(graph, _equal(members), alpha, tolerance)
        return [(v, m, steps) for v, m in x.items()]

    return by_seed(edges, _sets(seeds), work, "v long, x double, steps long")


def exponential_columns(edges: DataFrame, seeds: DataFrame, eps: float = 0.000917, terms: int = 6) -> DataFrame:
    """(seed, v, x): ``exponential_column`` of every vertex of ``seeds`` (seed, v)."""

    def work(graph, members):
        return [(v, x) for m in members for v, x in exponential_column(graph, m, eps, terms).items()]

    return by_seed(edges, _sets(seeds), work, "v long, x double")
