"""Graph operators on small graphs with known results."""

import math
import random

import numpy as np
import pytest
from graphloam import functions, sources
from graphloam.operators import cis, components, demon, diffusion, graph, merge, metrics, seedwise
from pyspark.sql import functions as F

DEMO = "0 1 3|1 2 1|2 3 4|3 4 4|0 5 3|2 7 4|4 7 4|4 8 1"
NETWORK = "1 2 1|1 3 1|2 3 1|3 4 1|3 5 1|3 6 1|4 5 1|4 6 1|5 6 1"
KARATE = """1: 2 3 4 5 6 7 8 9 11 12 13 14 18 20 22 32
2: 3 4 8 14 18 20 22 31
3: 4 8 9 10 14 28 29 33
4: 8 13 14
5: 7 11
6: 7 11 17
7: 17
9: 31 33 34
10: 34
14: 34
15: 33 34
16: 33 34
19: 33 34
20: 34
21: 33 34
23: 33 34
24: 26 28 30 33 34
25: 26 28 32
26: 32
27: 30 34
28: 34
29: 32 34
30: 33 34
31: 33 34
32: 33 34
33: 34"""
CLUSTERS = """0: 1 2 4 5
1: 3
2: 5 6
3: 4 6 7
4: 5 7 8 9
5: 6
6: 8
7: 8
8: 19
9: 10 11 13 14
10: 11 12 13
11: 12 13 14
12: 14
13: 24
15: 16 18 19 20 21
16: 17 18 19
17: 19 20 21
21: 22
22: 23 24 25 26
23: 24 25 26
24: 25 26"""
KARATE_COVER = ["25|26|29|32", "11|17|5|6|7", "24|25|26|28|29|32", "1|10|12|13|14|18|2|20|22|3|31|4|8|9", "10|15|16|19|21|23|24|27|28|30|31|33|34|9", "1|10|11|12|13|14|17|18|2|20|22|3|4|5|6|7|8", "10|15|16|19|21|23|24|25|26|27|28|29|3|30|31|32|33|34|9"]


def triples(text):
    if ":" not in text:
        return [(int(a), int(b), float(w)) for a, b, w in (x.split() for x in text.split("|"))]
    return [(int(k), int(v), 1.0) for line in text.split("\n") for k, _, vs in [line.partition(":")] for v in vs.split()]


@pytest.fixture(scope="module")
def edges(spark):
    return lambda text: graph.symmetrize(spark.createDataFrame(triples(text), "src long, dst long, w double"))


def sets(cover):
    out = {}
    for r in cover.collect():
        out.setdefault(r.comm_id, set()).add(r.member)
    return sorted(sorted(v) for v in out.values())


def cover_of(spark, lists):
    return spark.createDataFrame([(k, v) for k, m in enumerate(lists) for v in m], "comm_id long, member long")


def test_cis_covers(spark, edges):
    assert sets(cis.detect_cis(edges(DEMO))) == [[0, 1, 5], [2, 3, 4, 7, 8]]
    assert sets(cis.detect_cis(edges(NETWORK), 0.5)) == [[1, 2, 3], [3, 4, 5, 6]]
    seed = spark.createDataFrame([(1, 6), (1, 3), (1, 4)], "seed long, member long")
    assert sets(cis.detect_cis(edges(NETWORK), 0.5, seed)) == [[3, 4, 5, 6]]
    assert sets(cis.detect_cis(edges(KARATE))) == sorted(sorted(map(int, c.split("|"))) for c in KARATE_COVER)


def test_cis_by_request_equals_cis_by_broadcast(edges, monkeypatch):
    two = DEMO + "|100 101 1|101 102 2|102 100 1"
    whole = sets(cis.detect_cis(edges(two)))
    monkeypatch.setattr(seedwise, "BROADCAST_EDGES", 3)
    assert sets(cis.detect_cis(edges(two))) == whole


def test_seed_sets_over_components_and_without_edges(spark, edges, monkeypatch):
    e = edges("1 2 1|3 4 1")
    seeds = spark.createDataFrame([(1, 1), (1, 3), (2, 99)], "seed long, v long")
    whole = sorted(map(tuple, seedwise.hk_vector_exact(e, seeds, 2.0, 1e-2).collect()))
    monkeypatch.setattr(seedwise, "BROADCAST_EDGES", 1)
    assert sorted(map(tuple, seedwise.hk_vector_exact(e, seeds, 2.0, 1e-2).collect())) == whole
    assert {(s, v) for s, v, *_ in whole} == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 99)}


@pytest.mark.parametrize("name", ["hk", "hk_budget", "ppr", "exponential", "cis", "cis_compat"])
def test_seeds_that_fetch_their_neighbourhoods_see_what_a_broadcast_shows(spark, edges, monkeypatch, name):
    e, far = edges(KARATE), 1 << 60  # ids that doubles can't hold
    e = e.select((F.col("src") + far).alias("src"), (F.col("dst") + far).alias("dst"), "w")
    seeds = spark.createDataFrame([(1, far + 1), (2, far + 34), (3, far + 12), (3, far + 25), (4, 7)], "seed long, v long")
    sets_of = seeds.withColumnRenamed("v", "member")
    run = {
        "hk": lambda: seedwise.hk_vector_exact(e, seeds, 5.0, 1e-2),
        "hk_budget": lambda: seedwise.hk_vector_exact(e, seeds, 5.0, 1e-2, max_push=60),
        "ppr": lambda: seedwise.ppr_vector_exact(e, seeds),
        "exponential": lambda: seedwise.exponential_columns(e, seeds),
        "cis": lambda: cis.expand_seeds(e, sets_of),
        "cis_compat": lambda: cis.expand_seeds(e, sets_of, 0.3, compat=True),
    }[name]
    whole = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(seedwise, "BROADCAST_EDGES", 1)
    assert sorted(map(tuple, run().collect())) == whole and len({r[0] for r in whole}) == 4


def test_cis_compat_with_containment_fold(edges):
    grown = {}
    for r in cis.expand_seeds(edges(DEMO), compat=True).collect():
        grown.setdefault(r.seed, []).append(r.member)
    assert sorted(merge.fold([grown[s] for s in (0, 1, 2, 3, 4, 5, 7, 8)])) == [[0, 1, 5], [1, 2, 3, 4, 7, 8]]


def test_scalars():
    got = [functions.taylor_degree(*x) for x in ((5, 1e-2), (10, 1e-4), (15, 1e-4), (20, 1e-4), (20, 1e-3), (40, 5e-3), (80, 1e-2))]
    assert got == [11, 24, 31, 39, 35, 57, 102]
    assert functions.psi(11, 5)[:3] == pytest.approx([147.603848505, 29.320769701, 11.328307880])
    assert functions.push_thresholds(11, 5, 1e-2)[:3] == pytest.approx([9.14075446e-4, 4.60155225e-3, 1.19100801e-2])
    t = functions.heat_time(0.99)
    assert math.exp(t) / t == pytest.approx(100)


def test_heat_kernel_and_sweep(spark, edges):
    e = edges(CLUSTERS)
    seed = spark.createDataFrame([(0, 0)], "seed long, v long")
    v = diffusion.hk_vector(e, seed, 5.0, 1e-2)
    x = {r.v: r.x for r in v.collect()}
    assert [x[k] for k in range(4)] == pytest.approx([18.919622, 9.194502, 13.962639, 14.433376], abs=1e-5) and len(x) == 16
    status, members = diffusion.sweep(e, v)
    assert status.first().conductance == pytest.approx(2 / 34)
    assert {r.v for r in members.collect()} == set(range(9))
    k = edges(KARATE)
    both = spark.createDataFrame([(1, 1), (34, 34)], "seed long, v long")
    s, m = diffusion.sweep(k, diffusion.hk_vector(k, both, 5.0, 1e-2))
    assert {r.seed: round(r.conductance, 6) for r in s.collect()} == {1: 0.131579, 34: 0.131579}
    assert {r.v for r in m.where("seed = 34").collect()} == {9, 10, 15, 16, 19, 21, *range(23, 35)}
    assert diffusion.hk_vector(e, seed.where("false"), 5.0, 1e-2).count() == 0


def test_exact_pagerank_push():
    g = {}
    for a, b, _ in triples(CLUSTERS):
        g.setdefault(a, set()).add(b)
        g.setdefault(b, set()).add(a)
    vector, steps = seedwise.ppr_push({v: dict.fromkeys(sorted(n), 1.0) for v, n in g.items()}, {0: 1.0}, 0.99, 100)
    assert steps == 4809 and sum(vector.values()) < 1


def test_exact_heat_kernel_push_and_its_budget(spark, edges):
    e = edges(CLUSTERS)
    seeds = spark.createDataFrame([(0, 0), (9, 9), (9, 13)], "seed long, v long")
    rows = seedwise.hk_vector_exact(e, seeds, 5.0, 1e-2).collect()
    x = {r.v: r.x for r in rows if r.seed == 0}
    assert [x[k] for k in range(4)] == pytest.approx([18.919622, 9.194502, 13.962639, 14.433376], abs=1e-5) and len(x) == 16
    assert {r.pushes for r in rows if r.seed == 0} == {416}
    level = {(r.seed, r.v): r.x for r in diffusion.hk_vector(e, seeds, 5.0, 1e-2).collect()}
    assert {(r.seed, r.v): r.x for r in rows} == pytest.approx(level)
    budget = functions.push_budget(27)
    assert budget == 141
    short = seedwise.hk_vector_exact(e, seeds.where("seed = 0"), 5.0, 1e-2, budget).collect()
    assert all(141 <= r.pushes < 146 for r in short) and sum(r.x for r in short) < sum(x.values())


def test_exponential_column(spark, edges):
    g = edges(CLUSTERS)
    seeds = spark.createDataFrame([(1, 1), (500, 500)], "seed long, v long")
    got = {(r.seed, r.v): r.x for r in seedwise.exponential_columns(g, seeds, 1e-9, 20).collect()}
    rows = g.collect()
    deg = {v: sum(r.src == v for r in rows) for v in range(27)}
    exact, term = dict.fromkeys(range(27), 0.0), {1: 1.0}
    for k in range(25):
        for v, m in term.items():
            exact[v] += m
        after = {}
        for r in rows:
            after[r.dst] = after.get(r.dst, 0.0) + term.get(r.src, 0.0) / deg[r.src] / (k + 1)
        term = after
    assert all(got.get((1, v), 0.0) == pytest.approx(m, abs=1e-7) for v, m in exact.items())
    assert got[(500, 500)] == 1.0
    rough = {r.v: r.x for r in seedwise.exponential_columns(g, seeds.where("seed = 1")).collect()}
    assert sum(abs(rough.get(v, 0.0) - m) for v, m in exact.items()) < 0.01 and len(rough) < 27


def test_heat_kernel_compat_cover(edges):
    got = sets(diffusion.detect_hk(edges(DEMO), 15.0, 1e-4, compat=True))
    assert got == [[0, 1, 2], [0, 1, 5], [1, 2, 3, 7], [2, 3, 4], [2, 4, 7], [3, 4, 7, 8]]


def test_asynchronous_labels(edges):
    two = {1: {2: 1.0, 3: 1.0}, 2: {1: 1.0, 3: 1.0}, 3: {1: 1.0, 2: 1.0}, 7: {8: 1.0}, 8: {7: 1.0}, 9: {}}
    assert demon.passing_labels(two, 0) == {v: [v] for v in two}
    for seed in (None, 1, 2):
        got = demon.passing_labels(two, 20, seed)
        assert got[9] == [9] and got == demon.passing_labels(two, 20, seed)
        assert all(x in (1, 2, 3) for v in (1, 2, 3) for x in got[v]) and all(x in (7, 8) for v in (7, 8) for x in got[v])
    heavy = {1: {2: 5.0, 3: 1.0}, 2: {1: 5.0}, 3: {1: 1.0, 4: 9.0}, 4: {3: 9.0}}
    for seed in (None, *range(5)):  # at rest every vertex has the labels that weigh most around it
        got = demon.passing_labels(heavy, 100, seed)
        for v, near in heavy.items():
            votes = {x: sum(w for u, w in near.items() if x in got[u]) for u in near for x in got[u]}
            assert got[v] == sorted(x for x, n in votes.items() if n == max(votes.values()))
    local = demon.local_communities_async(edges(DEMO), 20, "edge")
    assert {r.ego for r in local.collect()} == {0, 1, 2, 3, 4, 5, 7, 8}
    assert local.join(local.selectExpr("ego e", "label l", "member m"), [local.ego == F.col("e"), local.label == F.col("l"), F.col("m") == local.ego], "left_anti").count() == 0
    found = sets(demon.detect_demon(edges(DEMO), 0.25, 1, 10, asynchronous=True))
    assert {v for s in found for v in s} == {0, 1, 2, 3, 4, 5, 7, 8} and all(len(s) > 1 for s in found)


@pytest.mark.parametrize(("name", "want"), [("max", 1.714232), ("min", 1.562831), ("mul", 0.745403), ("exp", 0.113686)])
def test_modularity(spark, edges, name, want):
    cover = cover_of(spark, [list(map(int, c.split("|"))) for c in KARATE_COVER])
    assert metrics.modularity(edges(KARATE), cover, name).first()[0] == pytest.approx(want, abs=1e-6)


def test_demon_properties(edges):
    found = sets(demon.detect_demon(edges(DEMO), 0.25, 1, 10))
    assert {v for s in found for v in s} == {0, 1, 2, 3, 4, 5, 7, 8} and all(len(s) > 1 for s in found)


def test_components_and_merges(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 102), (101, 102)], "src long, dst long")
    assert {r.comp for r in components.components(e).collect()} == {0, 100}
    assert components.components(e.where("false")).collect() == []
    c = cover_of(spark, [[1, 2, 3], [2, 3], [3, 4], [1, 2, 3], [9]])
    assert sets(merge.maximal(c)) == [[1, 2, 3], [3, 4], [9]]
    assert sets(merge.merge_overlapping(c, 0.4)) == [[1, 2, 3, 4]]
    assert merge.fold([[1, 2, 3], [2, 3, 4], [7]], "epsilon", 0.25, 1) == [[1, 2, 3, 4]]


def test_simple_edges_of_copies_at_one_position(spark):
    e = spark.createDataFrame([(1, 2, 5.0, 1), (2, 1, 3.0, 1), (1, 2, 9.0, 2), (2, 1, 7.0, 2), (4, 4, 1.0, 0)], "src long, dst long, w double, pos long")
    assert {tuple(r) for r in graph.symmetrize(e).collect()} == {(1, 2, 3.0), (2, 1, 3.0)}
    assert {tuple(r) for r in graph.undirected(e, "pos").collect()} == {(1, 2, 3.0), (2, 1, 3.0)}
    assert {tuple(r) for r in graph.undirected(e, "pos", last=True).collect()} == {(1, 2, 9.0), (2, 1, 9.0)}


def test_numbers_are_whole_over_many_partitions(spark):
    n = 420_000
    e = spark.range(n).select((F.col("id") * 7919 % 1_000_003).alias("src"), ((F.col("id") * 104_729 + 5) % 1_000_033).alias("dst"), F.col("id").alias("pos"), F.lit(1.0).alias("w"))
    src, dst = np.arange(n) * 7919 % 1_000_003, (np.arange(n) * 104_729 + 5) % 1_000_033
    both, at = np.unique(np.stack([src, dst], 1).ravel(), return_index=True)
    first = graph.encode_first(e, "pos").toArrow().to_pandas().sort_values("idx")
    assert (first.idx.to_numpy() == np.arange(len(both))).all() and (first.name.to_numpy() == both[np.argsort(at)]).all()
    ranked = graph.encode_sorted(e).toArrow().to_pandas().sort_values("idx")
    assert (ranked.idx.to_numpy() == np.arange(len(both))).all() and (ranked.name.to_numpy() == both).all()
    assert metrics.stride_by_degree(e, 20).count() == -(-len(np.unique(src)) // 20)
    truth = spark.range(3_000_000).select((F.col("id") % 300_000).alias("truth_id"), F.col("id").alias("member"))
    assert {r.truth_id for r in metrics.test_communities(truth, 9, 1000, 100).collect()} == set(range(0, 100_000, 1000))


def test_parsers_take_malformed_lines(spark):
    lines = spark.createDataFrame([(x,) for x in ["# c", "", "  1\t2  3.5 ", "3 4", "5 6 x", "7", "a b 1", None]], "value string")
    assert sorted(map(tuple, sources.weighted_edges(lines).collect())) == [(1, 2, 3.5), (3, 4, 1.0)]
    net, names = sources.delimited_network(spark.createDataFrame([("a| b|1.5",), ("a|c|x",), ("a|b",), ("||d|e||2",)], "value string"))
    assert sorted(map(tuple, net.collect())) == [("a", "b", 1.5), ("d", "e", 2.0)]
    assert sorted(r.name for r in names.collect()) == ["a", "b", "c", "d", "e"]


def plain_fold(sets, mode, eps=0.25, min_size=1, compat=False, batches=None):
    """The ordered folds as loops over lists."""
    out, batches = [], batches or [0] * len(sets)
    if mode == "last":
        for new in map(frozenset, sets):
            if len(new) <= min_size or new in out:
                continue
            old = next((o for o in out if o & new and len(o & new) / min(len(o), len(new)) >= eps), None)
            if old is not None:
                out.remove(old)
            if old is None or (old | new) not in out:
                out.append(new if old is None else old | new)
        return sorted(sorted(o) for o in out)
    bar, first = (1 - 1e-5 if mode == "containment" else eps), None
    for new, b in zip(map(set, sets), batches, strict=True):
        if compat and first is None and len(new) > min_size:
            first = b
        if compat and b == first:
            if len(new) > min_size:
                out.append(set(new))
            continue
        missed = merged = False
        for old in out:
            if len(old & new) / min(len(old), len(new)) > bar:
                old |= new
                merged = True
                break
            missed = True
        if (not merged or (compat and missed)) and (mode == "containment" or len(new) > min_size):
            out.append(set(new))
    return sorted(sorted(o) for o in out)


def test_ordered_folds_match_loops(spark):
    rng = random.Random(5)
    sets, batches = [], []
    for k in range(90):
        low = rng.choice([0, 100, 200])
        sets.append(sorted({low + rng.randrange(30) for _ in range(rng.randrange(1, 8))}))
        batches.append(k // 3)
    rows = spark.createDataFrame([(k, s, b) for k, (s, b) in enumerate(zip(sets, batches, strict=True))], "pos long, m array<long>, batch long")
    for mode, eps, least, compat in (("containment", 0, 1, False), ("epsilon", 0.25, 1, False), ("epsilon", 0.6, 2, False), ("epsilon", 0.6, 2, True), ("last", 0.5, 2, False)):
        want = plain_fold(sets, mode, eps, least, compat, batches)
        assert sorted(merge.fold(sets, mode, eps, least, compat, batches)) == want
        got = {}
        for r in merge.ordered_fold(rows, mode, eps, least, compat).collect():
            got.setdefault(r.comm_id, []).append(r.member)
        assert sorted(sorted(m) for m in got.values()) == want and len(want) > 1
    left, right = [[1, 2, 3], [4, 5]], [[2, 3], [4, 5, 6], [9]]
    both = sorted(merge.fold(right, start=left))
    assert both == [[1, 2, 3], [4, 5, 6], [9]]
    assert sorted(map(sorted, _lists(merge.reduce_covers(cover_of(spark, left), cover_of(spark, right))))) == both


def _lists(cover):
    out = {}
    for r in cover.collect():
        out.setdefault(r.comm_id, []).append(r.member)
    return list(out.values())


def test_drivers_fold_in_order(edges):
    e = edges(DEMO)
    grown = {}
    for r in cis.expand_seeds(e, compat=True).collect():
        grown.setdefault(r.seed, []).append(r.member)
    assert sorted(map(sorted, _lists(cis.detect_cis(e, compat=True)))) == [[0, 1, 5], [1, 2, 3, 4, 7, 8]]
    local = {}
    for r in demon.local_communities(e, 9).collect():
        local.setdefault((r.ego, r.label), []).append(r.member)
    keys = sorted(local)
    for kind, compat in (("epsilon", False), ("epsilon", True), ("last", False)):
        want = plain_fold([local[k] for k in keys], kind, 0.25, 1, compat, [k[0] for k in keys])
        assert sorted(map(sorted, _lists(demon.detect_demon(e, 0.25, 1, 10, fold=kind, compat=compat)))) == want


def test_synchronous_pagerank_settles_near_the_exact_push(spark, edges):
    e = edges(CLUSTERS)
    seeds = spark.createDataFrame([(0, 0), (9, 9), (9, 13), (77, 77)], "seed long, v long")
    got = {(r.seed, r.v): (r.x, r.converged) for r in diffusion.ppr_vector(e, seeds, 0.9, 100).collect()}
    exact = {(r.seed, r.v): r.x for r in seedwise.ppr_vector_exact(e, seeds, 0.9, 100).collect()}
    deg = {r.v: r.deg for r in graph.degrees(e).collect()}
    assert all(c for _, c in got.values()) and got[77, 77] == (1.0, True) and exact[77, 77] == 1.0
    for key in set(got) | set(exact):  # both leave at most 1e-3 * degree at every vertex
        assert abs(got.get(key, (0.0,))[0] - exact.get(key, 0.0)) <= 27 * 1e-3 * deg.get(key[1], 1)
    for seed in (0, 9):
        left = 1 - sum(x for (s, _), (x, _) in got.items() if s == seed)
        assert 0 <= left <= 1e-3 * sum(deg.values())
    short = diffusion.ppr_vector(e, seeds.where("seed = 0"), 0.99, 100, rounds=3).collect()
    assert short and not any(r.converged for r in short)


def test_lazy_walk_and_grids(spark, edges):
    e = edges(CLUSTERS)
    seeds = spark.createDataFrame([(0, 0)], "seed long, v long")
    g = seedwise.adjacency(*zip(*map(tuple, e.collect()), strict=True))
    x, steps = seedwise.lazy_push(g, {0: 1.0}, 0.9, 1e-4)
    assert steps > 10 and 1 - 1e-4 * sum(map(len, g.values())) <= sum(x.values()) <= 1
    one = {r.v: r.x for r in seedwise.lazy_vector_exact(e, seeds, 0.9, 1e-4).collect()}
    assert one == pytest.approx(x)
    best = diffusion.best_of_grid(e, seeds, diffusion.PPR_GRID, "ppr", neighbourhood=True, exact=True).first()
    single = [diffusion.sweep(e, seedwise.ppr_vector_exact(e, graph.ego_seeds(e, spark.createDataFrame([(0,)], "v long")), 0.99, p).select("seed", "v", "x"))[0].first().conductance for p in diffusion.PPR_GRID]
    assert best.conductance == min(single) and best.param == single.index(min(single))


def test_evaluation_of_true_communities(spark, edges):
    e = edges(CLUSTERS)
    truth = spark.createDataFrame([(1, v) for v in range(9)] + [(2, v) for v in range(9, 18)], "truth_id long, member long")
    got = {r.truth_id: r for r in metrics.evaluate(e, truth, lambda g, s: diffusion.grow_once(g, s, 5.0, 1e-2)).collect()}
    assert got[1].f1 == 1.0 and got[1].size == 9 and got[1].conductance == pytest.approx(2 / 34)
    mean = metrics.means(spark.createDataFrame([(r.f1, float(r.size)) for r in got.values()], "f1 double, size double"), "f1", "size").first()
    assert mean.mean_f1 == pytest.approx(sum(r.f1 for r in got.values()) / 2)


def test_files_logs_and_parameters(spark, tmp_path):
    (tmp_path / "a.smat").write_text("3 3 4\n0 1 2\n0 1 3\n1 2 1\n2 2 9\n")
    (tmp_path / "b.smat").write_text("0 1 2\n1 2 1\n")
    (tmp_path / "b.smat.info").write_text("3 4\n")
    e, size = sources.read_smat(spark, str(tmp_path / "a.smat"), pattern=False)
    assert size == (3, 3) and sorted(map(tuple, e.collect())) == [(0, 1, 5.0), (1, 2, 1.0), (2, 2, 9.0)]
    e, size = sources.read_smat(spark, str(tmp_path / "b.smat"))
    assert size == (3, 4) and sorted(map(tuple, e.collect())) == [(0, 1, 1.0), (1, 2, 1.0)]
    names = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "idx long, name long")
    cover = cover_of(spark, [[0, 1], [2]])
    lines = sources.result_lines(cover, names, 1.5)
    back = sources.result_log(lines)
    assert sorted(map(tuple, back.collect())) == [(0, 10), (0, 11), (1, 12)]
    assert tuple(sources.log_fields(lines).first()) == (2, 1.5)
    assert sorted(r.value for r in sources.named_lines(cover, names).collect()) == ["10(0),11(1),", "12(2),"]
    got = sources.parameters(["-n", "3", "-name", "+two", "words+", "-x", "-1.5", "-flag", "-ok", "yes"], {"n": 1, "ok": False, "x": 0.0, "left": 7})
    assert got == {"n": 3, "name": "two words", "x": -1.5, "flag": True, "ok": True, "left": 7}


def test_solvers_agree(spark):
    a, b = [[10.0, -1, 2, 0], [-1, 11, -1, 3], [2, -1, 10, -1], [0, 3, -1, 8]], [6.0, 25, -11, 15]
    x = functions.gauss_seidel(a, b)
    assert x == pytest.approx([1, 2, -1, 1])
    m = spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(a) for j, v in enumerate(row) if v], "i long, j long, a double")
    got = functions.jacobi(m, spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, b double"), 60, 1e-10)
    assert [r.x for r in sorted(got.collect())] == pytest.approx([1, 2, -1, 1])


def test_isolated_seeds_have_no_density(spark, edges):
    assert cis._dense(1, 0.0, 0.0, 0.0) == 0.0
    e = spark.createDataFrame([(1, 1)], "comm_id long, member long")
    assert cis.cover_density(edges("5 6 1"), e).first().density == 0.0
