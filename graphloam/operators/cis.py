"""Connected iterative scan: growth of seeds by density."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import EMPTY, density
from .components import cut
from .seedwise import by_seed


def community_stats(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(comm_id, n, w_in, w_out): inner weight, each edge once, and boundary weight of each community."""
    a, b = cover.select("comm_id", F.col("member").alias("src")), cover.select(F.col("comm_id").alias("c2"), F.col("member").alias("d2"))
    e = edges.join(a, "src")
    both = e.join(b, (e.comm_id == b.c2) & (e.dst == b.d2), "left")
    w = both.groupBy("comm_id").agg((F.sum(F.when(F.col("d2").isNotNull(), F.col("w")).otherwise(0.0)) / 2).alias("w_in"), F.sum(F.when(F.col("d2").isNull(), F.col("w")).otherwise(0.0)).alias("w_out"))
    return cover.groupBy("comm_id").agg(F.count("*").alias("n")).join(w, "comm_id", "left").fillna(0.0, ["w_in", "w_out"])


def cover_density(edges: DataFrame, cover: DataFrame, lam: float = 0.0) -> DataFrame:
    s = community_stats(edges, cover)
    return s.withColumn("density", density(F.col("n"), F.col("w_in"), F.col("w_out"), lam))


def entity_stats(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """(comm_id, v, is_member, w_in, w_out): of every member and neighbour, the weight into and out of the community."""
    near = cover.join(edges, cover.member == edges.src).select("comm_id", F.col("dst").alias("v"))
    known = near.unionByName(cover.select("comm_id", F.col("member").alias("v"))).distinct()
    e = known.join(edges, known.v == edges.src).select("comm_id", "v", "dst", "w")
    m = cover.select(F.col("comm_id").alias("c"), F.col("member").alias("m"))
    side = e.join(m, (e.comm_id == m.c) & (e.dst == m.m), "left")
    w = side.groupBy("comm_id", "v").agg(F.sum(F.when(F.col("m").isNotNull(), F.col("w")).otherwise(0.0)).alias("w_in"), F.sum(F.when(F.col("m").isNull(), F.col("w")).otherwise(0.0)).alias("w_out"))
    own = cover.select("comm_id", F.col("member").alias("v"), F.lit(True).alias("is_member"))
    return w.join(own, ["comm_id", "v"], "left").fillna(False, ["is_member"])


def candidate_gain(edges: DataFrame, cover: DataFrame, lam: float = 0.0) -> DataFrame:
    """(comm_id, v, gain): change of density if a neighbour joins."""
    s = cover_density(edges, cover, lam)
    c = entity_stats(edges, cover).where("not is_member").select("comm_id", "v", F.col("w_in").alias("ui"), F.col("w_out").alias("uo"))
    after = density(F.col("n") + 1, F.col("w_in") + F.col("ui"), F.col("w_out") + F.col("uo") - F.col("ui"), lam)
    return c.join(s, "comm_id").select("comm_id", "v", (after - F.col("density")).alias("gain"))


def member_loss(edges: DataFrame, cover: DataFrame, lam: float = 0.0) -> DataFrame:
    """(comm_id, v, gain): change of density if a member leaves."""
    s = cover_density(edges, cover, lam)
    c = entity_stats(edges, cover).where("is_member").select("comm_id", "v", F.col("w_in").alias("ui"), F.col("w_out").alias("uo"))
    after = density(F.col("n") - 1, F.col("w_in") - F.col("ui"), F.col("w_out") - F.col("uo") + F.col("ui"), lam)
    return c.join(s, "comm_id").select("comm_id", "v", (after - F.col("density")).alias("gain"))


def _dense(n: int, w_in: float, w_out: float, lam: float) -> float:
    if n < 1:
        return EMPTY
    share = w_in / (w_in + w_out) if w_in + w_out else 0.0
    return (1 - lam) * share + (lam if n == 1 else lam * 2 * w_in / (n * (n - 1)))


class Community:
    """A set of vertices that grows; what each known vertex has inside and outside is kept up to date."""

    def __init__(self, graph: dict, members: set, lam: float, compat: bool):
        self.graph, self.lam, self.compat = graph, lam, compat
        self.members = set(members)
        self.inside: dict = defaultdict(float)  # weight of a vertex into the community
        for v in members:
            for u, w in graph.get(v, {}).items():
                self.inside[u] += w
        self.w_in = sum(self.inside.get(v, 0.0) for v in members) / 2
        self.w_out = sum(self.total(v) - self.inside.get(v, 0.0) for v in members)

    def total(self, v) -> float:
        return sum(self.graph.get(v, {}).values())

    def value(self, dn=0, di=0.0, do=0.0) -> float:
        return _dense(len(self.members) + dn, self.w_in + di, self.w_out + do, self.lam)

    def order(self, some) -> list:
        return sorted(some, key=lambda v: (len(self.graph.get(v, {})), v))

    def move(self, v, sign: int, stats: tuple[float, float]) -> None:
        i, o = stats
        self.w_in += sign * i
        self.w_out += o if self.compat and sign > 0 else sign * (o - i)
        if sign > 0:
            self.members.add(v)
        elif not self.compat:
            self.members.discard(v)
        for u, w in self.graph.get(v, {}).items():
            self.inside[u] += sign * w

    def stats(self, v) -> tuple[float, float]:
        i = self.inside.get(v, 0.0)
        return i, self.total(v) - i

    def scan(self, sign: int) -> bool:
        """Take every candidate in the order of degree and id whose move raises the density."""
        if sign > 0:
            some = [v for v, w in self.inside.items() if w > 0 and v not in self.members]
        else:
            some = [v for v in self.members if len(self.members) > 1 or self.total(v)]  # an isolated seed stays
        before = {v: self.stats(v) for v in some} if self.compat else {}
        changed = False
        for v in self.order(some):
            i, o = before[v] if self.compat else self.stats(v)
            boundary = o if self.compat and sign > 0 else sign * (o - i)
            if self.value() < self.value(sign, sign * i, boundary):
                self.move(v, sign, (i, o))
                changed = True
        return changed

    def split(self) -> None:
        """Keep the densest component; its inner weight is that of the search tree, as the compat form has it."""
        left, best = set(self.members), None
        while left:
            root = min(left)
            left.discard(root)
            part, queue, w_in, w_out = {root}, [root], 0.0, 0.0
            for v in queue:
                for u, w in sorted(self.graph.get(v, {}).items()):
                    if u in left:
                        left.discard(u)
                        part.add(u)
                        queue.append(u)
                        w_in += w
                    elif u not in part:
                        w_out = w
            key = (_dense(len(part), w_in, w_out, self.lam), len(part))
            if best is None or key > best[0]:
                best = (key, part, w_in, w_out)
        if best:
            self.__init__(self.graph, best[1], self.lam, self.compat)
            self.w_in, self.w_out = best[2], best[3]


def expand(graph: dict, seed: set, lam: float = 0.0, compat: bool = False, rounds: int = 1000) -> tuple[list, bool]:
    """(members, whether it came to rest) of the community that grows from ``seed``.

    graph: vertex -> {neighbour: weight}.  An isolated seed never grows.  Every move raises the density, so the work ends
    by itself; only the ``compat`` form, whose totals start anew in each round, is given up after ``rounds``."""
    c = Community(graph, seed, lam, compat)
    for _ in range(rounds) if compat else iter(int, 1):
        grown = c.scan(1)
        shrunk = c.scan(-1)
        if compat:
            before = set(c.members)
            c.split()
            if not (grown or shrunk) or (c.members == before and c.members == set(seed)):
                return sorted(c.members), True
            if c.members == getattr(c, "last", None):
                return sorted(c.members), True
            last = set(c.members)
            c.last = last
        elif not grown and not shrunk:
            return sorted(c.members), True
    return sorted(c.members), False


def expand_seeds(edges: DataFrame, seeds: DataFrame | None = None, lam: float = 0.0, compat: bool = False) -> DataFrame:
    """(seed, member, converged): the community that grows from each seed set (seed, member), by default each vertex.

    Growth is sequential within a seed, so seeds are the unit of work; see ``by_seed``."""
    if seeds is None:
        seeds = edges.select(F.col("src").alias("seed"), F.col("src").alias("member")).distinct()

    def work(graph, members):
        got, ok = expand(graph, set(members), lam, compat)
        return [(v, ok) for v in got]

    return by_seed(edges, seeds, work, "member long, converged boolean")


def detect_cis(edges: DataFrame, lam: float = 0.0, seeds: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """(comm_id, member, converged): distinct communities, named by their smallest seed.

    ``compat``: the communities are folded in the order of seeds, each into the first that holds it or that it holds.
    converged: whether the growth of all seeds of a community (compat: of the one that began it) came to rest."""
    from .merge import ordered_fold

    grown = cut(expand_seeds(edges, seeds, lam, compat).groupBy("seed").agg(F.array_sort(F.collect_set("member")).alias("m"), F.min("converged").alias("converged")))
    if compat:
        folded = ordered_fold(grown.select(F.col("seed").alias("pos"), "m"))
        return folded.join(grown.select(F.col("seed").alias("comm_id"), "converged"), "comm_id")
    return grown.groupBy("m").agg(F.min("seed").alias("comm_id"), F.min("converged").alias("converged")).select("comm_id", F.explode("m").alias("member"), "converged")
