"""DEMON: label propagation in ego networks, merged into a cover."""

from __future__ import annotations

from random import Random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, cut
from .graph import ego_minus_ego, number
from .merge import exact_dedup, merge_overlapping, ordered_fold


def propagate_labels(edges: DataFrame, rounds: int, by: list[str] | None = None, weights: DataFrame | None = None, vote: str = "unit", every: int = 4) -> DataFrame:
    """(*by, v, label) after synchronous ``rounds``: each vertex takes the label with most votes, the smallest of ties.

    edges: (*by, src, dst[, w]), both directions; each group of ``by`` is a graph of its own.  vote: ``unit``, ``edge``
    (by w) or ``vertex`` (by ``weights`` (v, vw)).  Vertices without an edge aren't in ``edges``."""
    by = by or []
    e = edges.withColumn("__w", F.col("w") if vote == "edge" else F.lit(1.0)).select(*by, "src", "dst", "__w")
    if vote == "vertex" and weights is not None:
        e = e.join(weights.select(F.col("v").alias("dst"), "vw"), "dst").select(*by, "src", "dst", F.col("vw").alias("__w"))
    e = cut(e)
    labels, done = e.select(*by, F.col("src").alias("v")).distinct().withColumn("label", F.col("v")), 0
    while done < rounds:
        step = min(every, rounds - done)
        mark = labels
        for _ in range(step):
            votes = e.join(labels.select(*by, F.col("v").alias("dst"), "label"), [*by, "dst"]).groupBy(*by, "src", "label").agg(F.sum("__w").alias("s"))
            labels = votes.groupBy(*by, F.col("src").alias("v")).agg(F.max_by("label", F.struct("s", -F.col("label"))).alias("label"))
        labels, done = cut(labels), done + step
        if step == every and labels.exceptAll(mark).isEmpty():  # from here on it goes round in ``every`` rounds
            rounds = done + (rounds - done) % every
    return labels


def local_communities(edges: DataFrame, rounds: int = 99, vote: str = "unit", weights: DataFrame | None = None) -> DataFrame:
    """(ego, label, member): the communities of each vertex's neighbourhood, the vertex added to each; see ``propagate_labels``."""
    half = cut(ego_minus_ego(edges))
    inner = half.select("ego", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(half.select("ego", F.col("b").alias("src"), F.col("a").alias("dst")))
    if vote == "edge":
        inner = inner.join(edges.select("src", "dst", "w"), ["src", "dst"])
    labels = propagate_labels(inner, rounds, ["ego"], weights, vote)
    near = edges.select(F.col("src").alias("ego"), F.col("dst").alias("v")).where("ego <> v").distinct()
    named = near.join(labels, ["ego", "v"], "left").select("ego", F.coalesce("label", "v").alias("label"), F.col("v").alias("member"))
    return named.unionByName(named.select("ego", "label", F.col("ego").alias("member")).distinct())


def passing_labels(graph: dict, max_iter: int = 100, seed: int | None = None) -> dict[int, list[int]]:
    """vertex -> labels after asynchronous propagation: each vertex reads what others have just taken.

    graph: vertex -> {neighbour: weight of the vote}.  The first pass takes one label of the neighbours', later ones keep
    all that tie for the most votes; every pass counts twice towards ``max_iter``.  Without ``seed`` vertices are
    visited in id order and the first pass takes the smallest label, with it both are random.  A vertex without
    neighbours keeps its own label.
    """
    labels: dict[int, list[int]] = {v: [v] for v in graph}
    turns = sorted(v for v in graph if graph[v])
    chance = None if seed is None else Random(seed)
    for turn in range(-(-max_iter // 2)):
        if chance:
            chance.shuffle(turns)
        changed = False
        for v in turns:
            votes: dict[int, float] = {}
            for u, w in graph[v].items():
                for x in labels[u]:
                    votes[x] = votes.get(x, 0.0) + w
            if turn == 0:
                new = [chance.choice(sorted(votes)) if chance else min(votes)]
            else:
                most = max(votes.values())
                new = sorted(x for x, n in votes.items() if n == most)
            changed |= new != labels[v]
            labels[v] = new
        if turn and not changed:  # a pass that changes nothing is the last that could
            break
    return labels


def local_communities_async(edges: DataFrame, max_iter: int = 100, vote: str = "unit", seed: int | None = None) -> DataFrame:
    """(ego, label, member) by ``passing_labels`` in each vertex's neighbourhood; labels may overlap.

    vote: ``unit`` or ``edge`` (by w).  The neighbourhood of one vertex is worked on in one task, as its visits are in
    sequence; where that is too much, ``local_communities`` spreads the work by synchronous rounds."""
    half = ego_minus_ego(edges)
    if vote == "edge":
        half = half.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"), ["a", "b"])
    else:
        half = half.withColumn("w", F.lit(1.0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ego = int(pdf.ego.iloc[0])
        graph: dict[int, dict[int, float]] = {}
        for a, b, w in sorted(zip(pdf.a.tolist(), pdf.b.tolist(), pdf.w.tolist(), strict=True)):
            graph.setdefault(a, {})[b] = w
            graph.setdefault(b, {})[a] = w
        own = passing_labels(graph, max_iter, None if seed is None else hash((seed, ego)))
        return pd.DataFrame([(ego, x, v) for v, xs in own.items() for x in xs], columns=["ego", "label", "member"])

    labelled = cut(half.groupBy("ego").applyInPandas(run, "ego long, label long, member long"))
    near = edges.select(F.col("src").alias("ego"), F.col("dst").alias("member")).where("ego <> member").distinct()
    alone = near.join(labelled, ["ego", "member"], "left_anti").select("ego", F.col("member").alias("label"), "member")
    named = labelled.unionByName(alone)
    return named.unionByName(named.select("ego", "label", F.col("ego").alias("member")).distinct())


def detect_demon(edges: DataFrame, eps: float = 0.25, min_size: int = 1, max_iter: int = 100, inclusive: bool = False, asynchronous: bool = False, vote: str = "unit", fold: str = "epsilon", compat: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """(comm_id, member): local communities of all vertices, merged where they overlap by more than ``eps``.

    ``max_iter - 1`` synchronous rounds are run, as the labels of the last round are not used; ``asynchronous``: see
    ``local_communities_async``.  vote: see ``propagate_labels``.  fold: ``epsilon`` merges in the order of (vertex,
    label), each community into the first that it overlaps enough (``compat``: the first vertex's are not merged, and
    one that merges with a later entry is also kept); ``last`` is the form with at least ``eps`` in which merged ones
    move to the end; ``closure`` follows all chains of overlaps without an order (``inclusive``: at least ``eps``),
    coarser but spread over tasks."""
    local = cut(local_communities_async(edges, max_iter, vote) if asynchronous else local_communities(edges, max_iter - 1, vote, weights))
    sets = local.groupBy("ego", "label").agg(F.array_sort(F.collect_set("member")).alias("m"))
    if fold != "closure":
        rows = number(sets.withColumn("key", F.struct("ego", "label")), "key").select(F.col("idx").alias("pos"), "m", F.col("ego").alias("batch"))
        return ordered_fold(rows, fold, eps, min_size, compat)
    one = sets.groupBy("m").agg(F.min(F.struct("ego", "label")).alias("k"))
    cover = one.select(F.xxhash64("k.ego", "k.label").alias("comm_id"), F.explode("m").alias("member"))
    return merge_overlapping(cut(cover), eps, min_size, inclusive)


def hdemon(edges: DataFrame, eps: float = 0.25, min_size: int = 1, max_iter: int = 20, levels: int = 5, fold: str = "epsilon", meta: str = "shared") -> DataFrame:
    """(level, comm_id, member): DEMON again and again on the graph of communities.

    meta: ``shared`` joins communities that share a member, ``all`` every two of over ``min_size`` members.  It ends when
    a level has as many vertices as components, or after ``levels``."""
    from .merge import complete_meta_graph, overlap_pairs

    out, now = None, edges
    for level in range(levels):
        cover = cut(exact_dedup(detect_demon(now, eps, min_size, max_iter, fold=fold)))
        rows = cover.withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
        linked = complete_meta_graph(cover, min_size) if meta == "all" else overlap_pairs(cover)
        pairs = cut(linked.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")))
        comp = components(pairs)
        if comp.where("v <> comp").isEmpty():
            break
        now = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return out.select("level", "comm_id", "member")
