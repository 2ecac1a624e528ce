"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions, sources
from ..functions import conductance, psi, push_budget, push_thresholds, taylor_degree
from ..operators import cis, components, demon, diffusion, graph, merge, metrics, seedwise
from .projections import nation_trade, order_cover, part_copurchase, region_cover, shared_lines, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The heat kernel's usual parameters; vectors are given as shares of e**t.
HK_T, HK_EPS = 15.0, 1e-4


def trade_sql(name: str = "e") -> str:
    return f"""{name}_p AS (SELECT least(c_nationkey, s_nationkey)::BIGINT AS a, greatest(c_nationkey, s_nationkey)::BIGINT AS b, count(*)::DOUBLE AS w
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT a AS src, b AS dst, w FROM {name}_p UNION ALL SELECT b, a, w FROM {name}_p)"""


PARTS = """pp AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
pk AS (SELECT x.p AS a, y.p AS b, count(*)::DOUBLE AS w FROM pp x JOIN pp y ON x.o = y.o AND x.p < y.p GROUP BY 1, 2 HAVING count(*) >= 2),
e AS MATERIALIZED (SELECT a AS src, b AS dst, w FROM pk UNION ALL SELECT b, a, w FROM pk)"""
REGIONS = "c AS (SELECT n_regionkey::BIGINT AS comm_id, n_nationkey::BIGINT AS member FROM nation)"
OVERLAPPING = trade_sql("e2") + ", c AS MATERIALIZED (SELECT src AS comm_id, dst AS member FROM (SELECT *, avg(w) OVER (PARTITION BY src) AS mean FROM e2) WHERE w > mean UNION SELECT src, src FROM e2)"
PAIRS = """n AS (SELECT comm_id, count(*) AS n FROM c GROUP BY 1),
o AS (SELECT x.comm_id AS a, y.comm_id AS b, count(*) AS k FROM c x JOIN c y ON x.member = y.member AND x.comm_id < y.comm_id GROUP BY 1, 2),
q AS MATERIALIZED (SELECT a, b, k AS shared, na.n AS na, nb.n AS nb FROM o JOIN n na ON na.comm_id = a JOIN n nb ON nb.comm_id = b)"""
DEG = "d AS MATERIALIZED (SELECT src AS v, count(*) AS deg FROM e GROUP BY 1)"
CC = """r AS (SELECT v, v AS root FROM nodes UNION SELECT r.v, l.y FROM r JOIN (SELECT x, y FROM links UNION SELECT y, x FROM links) l ON r.root = l.x),
cc AS (SELECT v, min(root) AS comp FROM r GROUP BY 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines as an edge-list file may hold them: edges with and without weight, comments, blank and malformed lines."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 7
    line = F.when(k == 0, F.concat(F.lit("# "), F.col("o_orderkey"))).when(k == 1, F.lit("")).when(k == 2, F.concat_ws(" ", "o_custkey", "o_orderkey")).when(k == 3, F.concat_ws("\t", "o_custkey", "o_orderkey", F.lit("bad"))).otherwise(F.concat_ws("  ", "o_custkey", "o_orderkey", F.lit("2.5")))
    return o.select(line.alias("value"))


@query("SELECT o_custkey AS src, o_orderkey AS dst, CASE WHEN o_orderkey % 7 = 2 THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END AS w FROM orders WHERE o_orderkey % 7 NOT IN (0, 1, 3)")
def edge_list_parse(spark, d):
    return sources.weighted_edges(_order_lines(spark, d))


@query("SELECT o_custkey AS src, o_orderkey AS dst, 1.0::DOUBLE AS w FROM orders WHERE o_orderkey % 7 NOT IN (0, 1)")
def plain_edge_parse(spark, d):
    return sources.plain_edges(_order_lines(spark, d))


def _piped(spark, d):
    o = table(spark, d, "orders")
    w = F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise(F.lit("1.5"))
    return o.select(F.when(F.col("o_orderkey") % 11 == 0, F.concat_ws("|", "o_custkey", "o_orderkey")).otherwise(F.concat(F.lit("c"), "o_custkey", F.lit(" | o"), "o_orderkey", F.lit("||"), w)).alias("value"))


@query("SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 1.5::DOUBLE AS w FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0")
def delimited_network_parse(spark, d):
    return sources.delimited_network(_piped(spark, d))[0]


@query("SELECT 'c' || o_custkey AS name FROM orders WHERE o_orderkey % 11 <> 0 UNION SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 11 <> 0")
def delimited_vertices(spark, d):
    return sources.delimited_network(_piped(spark, d))[1]


@query("SELECT o_custkey AS comm_id, CAST(o_orderkey AS VARCHAR) AS member FROM orders")
def community_parse(spark, d):
    lines = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), "|").alias("value"))
    return sources.communities(lines, F.col("o_custkey"))


@query("""WITH m AS (SELECT l_suppkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS m FROM lineitem GROUP BY 1),
k AS (SELECT row_number() OVER (ORDER BY len(m) DESC, m) - 1 AS comm_id, m FROM m) SELECT comm_id, unnest(m) AS member FROM k""")
def result_log_parse(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("m"))
    lines = sets.select(F.concat(F.lit("name result:["), F.to_json("m"), F.lit("]")).alias("value")).unionByName(sets.select(F.lit("comm size:3").alias("value")))
    return sources.result_log(lines)


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, 1.0::DOUBLE AS w FROM lineitem WHERE l_suppkey <> l_partkey")
def smat_pattern_graph(spark, d):
    return sources.smat(table(spark, d, "lineitem").select(F.concat_ws(" ", "l_suppkey", "l_partkey", "l_quantity").alias("value")))


@query("SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2")
def smat_weighted_graph(spark, d):
    return sources.smat(table(spark, d, "lineitem").select(F.concat_ws(" ", "l_suppkey", "l_partkey", "l_quantity").alias("value")), pattern=False)


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, 1.0::DOUBLE AS w FROM lineitem")
def adjacency_parse(spark, d):
    sets = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), ", ").alias("m"))
    return sources.adjacency(sets.select(F.concat(F.lit("{"), "l_suppkey", F.lit(": {"), "m", F.lit("}}")).alias("value")))


@query("SELECT CAST(o_custkey AS VARCHAR) || '|' || CAST(o_orderkey AS VARCHAR) || '|1.0' AS value FROM orders")
def network_write(spark, d):
    return sources.network_lines(table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit(1.0).alias("w")))


@query("SELECT string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS value FROM orders GROUP BY o_custkey")
def community_write(spark, d):
    return sources.community_lines(table(spark, d, "orders").select(F.col("o_custkey").alias("comm_id"), F.col("o_orderkey").alias("member")))


@query("SELECT o_custkey || ',' || o_orderkey AS value FROM orders")
def delimiter_change(spark, d):
    return sources.change_delimiter(table(spark, d, "orders").select(F.concat_ws("|", "o_custkey", "o_orderkey").alias("value")), "|", ",")


def _directed(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("w"), F.expr("((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey").alias("pos"))


_DIRECTED = "e0 AS (SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS w, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS pos FROM lineitem)"


@query(f"WITH {_DIRECTED}, x AS (SELECT src AS name, pos * 2 AS p FROM e0 UNION ALL SELECT dst, pos * 2 + 1 FROM e0), f AS (SELECT name, min(p) AS p FROM x GROUP BY 1) SELECT row_number() OVER (ORDER BY p) - 1 AS idx, name FROM f")
def encode_first_appearance(spark, d):
    return graph.encode_first(_directed(spark, d), "pos")


@query(f"WITH {_DIRECTED}, x AS (SELECT src AS name FROM e0 UNION SELECT dst FROM e0) SELECT row_number() OVER (ORDER BY name) - 1 AS idx, name FROM x")
def encode_sorted(spark, d):
    return graph.encode_sorted(_directed(spark, d))


def _dedup_sql(order: str) -> str:
    return f"WITH {_DIRECTED}, o AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, first(w ORDER BY pos {order}, w {order}) AS w FROM e0 WHERE src <> dst GROUP BY 1, 2) SELECT * FROM o UNION ALL SELECT dst, src, w FROM o"


@query(_dedup_sql("ASC"))
def undirected_dedup_first(spark, d):
    return graph.undirected(_directed(spark, d), "pos")


@query(_dedup_sql("DESC"))
def undirected_dedup_last(spark, d):
    return graph.undirected(_directed(spark, d), "pos", last=True)


@query(f"WITH {_DIRECTED} SELECT src, dst FROM e0 WHERE src <> dst UNION SELECT dst, src FROM e0 WHERE src <> dst")
def symmetrize(spark, d):
    return graph.symmetrize(_directed(spark, d)).select("src", "dst")


@query(f"WITH {PARTS} SELECT p_partkey AS v, count(e.src) AS deg, coalesce(sum(w), 0.0) AS strength FROM part LEFT JOIN e ON p_partkey = src GROUP BY 1")
def degree(spark, d):
    return graph.degrees(part_copurchase(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("v")))


@query(f"WITH {PARTS} SELECT count(*) AS volume, count(DISTINCT src) AS vertices FROM e")
def volume(spark, d):
    return part_copurchase(spark, d).agg(F.count("*").alias("volume"), F.countDistinct("src").alias("vertices"))


@query(f"WITH {trade_sql()} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM e")
def row_normalize(spark, d):
    return graph.normalize_rows(nation_trade(spark, d)).withColumn("w", F.round("w", 6))


@query(f"WITH {PARTS} SELECT p_partkey AS v, dst, w FROM part LEFT JOIN e ON p_partkey = src")
def neighbourhood(spark, d):
    return graph.neighbours(part_copurchase(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("v")))


def _nation_pairs(spark, d):
    """Each nation with the next three by id: a stated set of candidates."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("a"))
    return n.select("a", F.explode(F.sequence(F.col("a") + 1, F.col("a") + 3)).alias("b"))


_NATION_PAIRS = "np AS (SELECT n_nationkey::BIGINT AS a, unnest([n_nationkey + 1, n_nationkey + 2, n_nationkey + 3])::BIGINT AS b FROM nation)"


@query(f"WITH {trade_sql()}, {_NATION_PAIRS} SELECT a, b FROM np WHERE EXISTS (SELECT 1 FROM e WHERE src = a AND dst = b)")
def edge_exists_semi(spark, d):
    return graph.edges_in(nation_trade(spark, d), _nation_pairs(spark, d))


@query(f"WITH {trade_sql()}, {_NATION_PAIRS} SELECT src, dst, w FROM e WHERE NOT EXISTS (SELECT 1 FROM np WHERE (src = a AND dst = b) OR (src = b AND dst = a))")
def edge_delete_anti(spark, d):
    return graph.remove_edges(nation_trade(spark, d), _nation_pairs(spark, d))


@query("WITH s AS (SELECT month(o_orderdate)::BIGINT AS step, unnest([o_custkey, -o_orderkey]) AS v FROM orders) SELECT v, count(DISTINCT step) AS n_steps, min(step) AS first_step FROM s GROUP BY 1")
def snapshot_union(spark, d):
    o = table(spark, d, "orders")
    return graph.snapshot_vertices(o.select(F.month("o_orderdate").cast("bigint").alias("step"), F.col("o_custkey").alias("src"), (-F.col("o_orderkey")).alias("dst")))


@query(f"WITH {trade_sql()} SELECT src AS seed, dst AS v FROM e UNION SELECT src, src FROM e")
def ego_seed_set(spark, d):
    e = nation_trade(spark, d)
    return graph.ego_seeds(e, e.select(F.col("src").alias("v")).distinct())


_STATS = """i AS (SELECT x.comm_id, sum(w) / 2 AS w_in FROM c x JOIN e ON src = x.member JOIN c y ON y.comm_id = x.comm_id AND y.member = dst GROUP BY 1),
o AS (SELECT x.comm_id, sum(w) AS w_out FROM c x JOIN e ON src = x.member WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.comm_id = x.comm_id AND y.member = dst) GROUP BY 1),
st AS MATERIALIZED (SELECT n.comm_id, n.n, coalesce(w_in, 0.0) AS w_in, coalesce(w_out, 0.0) AS w_out FROM (SELECT comm_id, count(*) AS n FROM c GROUP BY 1) n LEFT JOIN i USING (comm_id) LEFT JOIN o USING (comm_id))"""


def _density_sql(n: str, a: str, b: str, lam: float) -> str:
    return f"({1 - lam} * (CASE WHEN {a} + {b} = 0 THEN 0.0 ELSE {a} / ({a} + {b}) END) + CASE WHEN {n} = 1 THEN {lam} ELSE {2 * lam} * {a} / ({n} * ({n} - 1)) END)"


@query(f"WITH {trade_sql()}, {REGIONS}, {_STATS} SELECT comm_id, n, w_in, w_out, round({_density_sql('n', 'w_in', 'w_out', 0.25)}, 6) AS density FROM st")
def density_of_cover(spark, d):
    return cis.cover_density(nation_trade(spark, d), region_cover(spark, d), 0.25).withColumn("density", F.round("density", 6))


_ENTITIES = """kn AS (SELECT c.comm_id, dst AS v FROM c JOIN e ON src = member UNION SELECT comm_id, member FROM c),
en AS MATERIALIZED (SELECT k.comm_id, k.v, coalesce(sum(w) FILTER (WHERE m.member IS NOT NULL), 0.0) AS ui, coalesce(sum(w) FILTER (WHERE m.member IS NULL), 0.0) AS uo
 FROM kn k JOIN e ON src = k.v LEFT JOIN c m ON m.comm_id = k.comm_id AND m.member = dst GROUP BY 1, 2)"""


@query(f"WITH {trade_sql()}, {REGIONS}, {_ENTITIES} SELECT en.comm_id, v, ui AS w_in, uo AS w_out, c.member IS NOT NULL AS is_member FROM en LEFT JOIN c ON c.comm_id = en.comm_id AND c.member = v")
def seed_fringe_stats(spark, d):
    return cis.entity_stats(nation_trade(spark, d), region_cover(spark, d)).select("comm_id", "v", "w_in", "w_out", "is_member")


@query(f"""WITH {trade_sql()}, {REGIONS}, {_STATS}, {_ENTITIES} SELECT en.comm_id, v, round({_density_sql('(n + 1)', '(w_in + ui)', '(w_out + uo - ui)', 0.0)} - {_density_sql('n', 'w_in', 'w_out', 0.0)}, 6) AS gain
FROM en JOIN st ON st.comm_id = en.comm_id LEFT JOIN c ON c.comm_id = en.comm_id AND c.member = v WHERE c.member IS NULL""")
def candidate_gain(spark, d):
    return cis.candidate_gain(nation_trade(spark, d), region_cover(spark, d)).withColumn("gain", F.round("gain", 6))


_COMM_CC = """links AS (SELECT comm_id * 1000 + src AS x, comm_id * 1000 + dst AS y FROM e JOIN c ON member = src WHERE EXISTS (SELECT 1 FROM c z WHERE z.comm_id = c.comm_id AND z.member = dst)),
nodes AS (SELECT comm_id * 1000 + member AS v FROM c), """ + CC


@query(f"WITH RECURSIVE {trade_sql()}, {REGIONS}, {_COMM_CC} SELECT v // 1000 AS comm_id, v % 1000 AS member, comp % 1000 AS comp FROM cc")
def community_components(spark, d):
    return components.community_components(nation_trade(spark, d), region_cover(spark, d))


@query(f"""WITH RECURSIVE {trade_sql()}, {REGIONS}, {_COMM_CC}, parts AS (SELECT v // 1000 AS old, v % 1000 AS member, comp AS comm_id FROM cc)
, p AS (SELECT comm_id, count(*) AS n, any_value(old) AS old FROM parts GROUP BY 1),
i AS (SELECT x.comm_id, sum(w) / 2 AS w_in FROM parts x JOIN e ON src = x.member JOIN parts y ON y.comm_id = x.comm_id AND y.member = dst GROUP BY 1),
o AS (SELECT x.comm_id, sum(w) AS w_out FROM parts x JOIN e ON src = x.member WHERE NOT EXISTS (SELECT 1 FROM parts y WHERE y.comm_id = x.comm_id AND y.member = dst) GROUP BY 1),
s AS (SELECT p.*, coalesce(w_in, 0.0) AS a, coalesce(w_out, 0.0) AS b FROM p LEFT JOIN i USING (comm_id) LEFT JOIN o USING (comm_id)),
t AS (SELECT old, comm_id % 1000 AS comp, n, round({_density_sql('n', 'a', 'b', 0.0)}, 6) AS density FROM s)
SELECT old AS comm_id, comp, density, n FROM (SELECT *, row_number() OVER (PARTITION BY old ORDER BY density DESC, n DESC, comp) AS rn FROM t) WHERE rn = 1""")
def split_and_choose(spark, d):
    e = nation_trade(spark, d)
    parts = components.cut(components.community_components(e, region_cover(spark, d)))
    cover = parts.select((F.col("comm_id") * 1000 + F.col("comp")).alias("comm_id"), "member")
    dens = cis.cover_density(e, cover).select(F.expr("comm_id div 1000").alias("comm_id"), (F.col("comm_id") % 1000).alias("comp"), F.round("density", 6).alias("density"), "n")
    return metrics.split_and_choose(parts.select("comm_id", "comp").distinct(), dens)


@query("""WITH RECURSIVE ln AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), lg AS (SELECT * FROM ln WHERE length(line) > 20),
fs AS (SELECT line, min(doc_id) AS f FROM lg GROUP BY 1 HAVING count(*) > 1), links AS MATERIALIZED (SELECT DISTINCT doc_id AS x, f AS y FROM lg JOIN fs USING (line) WHERE doc_id <> f),
nodes AS (SELECT x AS v FROM links UNION SELECT y FROM links), """ + CC + " SELECT v, comp FROM cc")
def graph_components(spark, d):
    return components.components(shared_lines(spark, d))


_TRIANGLES = "tri AS MATERIALIZED (SELECT x.src AS ego, x.dst AS a, y.dst AS b FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst JOIN e z ON z.src = x.dst AND z.dst = y.dst)"


@query(f"WITH {PARTS}, {_TRIANGLES} SELECT ego, a, b FROM tri")
def ego_minus_ego_edges(spark, d):
    return graph.ego_minus_ego(part_copurchase(spark, d))


def _label_sql(rounds: int, edges: str, by: str, weight: str = "1") -> str:
    key = f"{by}, " if by else ""
    out = [f"l0 AS MATERIALIZED (SELECT DISTINCT {key}src AS v, src AS label FROM {edges})"]
    for k in range(rounds):
        on = f"l.{by} = x.{by} AND " if by else ""
        xk = f"x.{by}, " if by else ""
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT {key}v, label FROM (SELECT *, row_number() OVER (PARTITION BY {key}v ORDER BY s DESC, label) AS rn FROM (SELECT {xk}x.src AS v, l.label, sum({weight}) AS s FROM {edges} x JOIN l{k} l ON {on}l.v = x.dst GROUP BY ALL)) WHERE rn = 1)")
    return ", ".join(out)


@query(f"WITH {PARTS}, {_label_sql(99, 'e', '')} SELECT v, label FROM l99")
def label_propagation_k(spark, d):
    return demon.propagate_labels(part_copurchase(spark, d), 99)


@query(f"WITH {PARTS}, {_label_sql(5, 'e', '', '(x.dst % 3 + 1)')} SELECT v, label FROM l5")
def label_vertex_vote(spark, d):
    e = part_copurchase(spark, d)
    return demon.propagate_labels(e, 5, weights=e.select(F.col("src").alias("v"), (F.col("src") % 3 + 1).cast("double").alias("vw")).distinct(), vote="vertex")


_LOCAL = f"""{_TRIANGLES}, eg AS MATERIALIZED (SELECT ego, a AS src, b AS dst FROM tri UNION ALL SELECT ego, b, a FROM tri), {_label_sql(3, 'eg', 'ego')},
nm AS (SELECT e.src AS ego, coalesce(l3.label, e.dst) AS label, e.dst AS member FROM e LEFT JOIN l3 ON l3.ego = e.src AND l3.v = e.dst),
lc AS MATERIALIZED (SELECT * FROM nm UNION SELECT ego, label, ego FROM nm)"""


@query(f"WITH {PARTS}, {_LOCAL} SELECT ego, label, member FROM lc")
def demon_local_communities(spark, d):
    return demon.local_communities(part_copurchase(spark, d), 3)


@query(f"""WITH RECURSIVE {trade_sql()}, {_LOCAL}, sets AS (SELECT m, row_number() OVER (ORDER BY m) AS comm_id FROM (SELECT DISTINCT m FROM (SELECT ego, label, list(DISTINCT member ORDER BY member) AS m FROM lc GROUP BY 1, 2))),
c AS MATERIALIZED (SELECT comm_id, unnest(m) AS member FROM sets), {PAIRS}, links AS (SELECT a AS x, b AS y FROM q WHERE shared / least(na, nb) > 0.25), nodes AS (SELECT comm_id AS v FROM sets), {CC},
g AS (SELECT DISTINCT comp, member FROM c JOIN cc ON v = comm_id), z AS (SELECT comp, list(member ORDER BY member) AS m FROM g GROUP BY 1 HAVING count(*) > 1) SELECT array_to_string(m, '|') AS members FROM z""")
def demon_cover_closure(spark, d):
    return sources.community_lines(demon.detect_demon(components.cut(nation_trade(spark, d)), 0.25, 1, 4, fold="closure")).withColumnRenamed("value", "members")


@query()
def demon_cover(spark, d):
    return sources.community_lines(demon.detect_demon(components.cut(part_copurchase(spark, d)))).withColumnRenamed("value", "members")


@query()
def demon_cover_compat(spark, d):
    return sources.community_lines(demon.detect_demon(components.cut(nation_trade(spark, d)), compat=True)).withColumnRenamed("value", "members")


@query()
def demon_cover_last(spark, d):
    return sources.community_lines(demon.detect_demon(components.cut(nation_trade(spark, d)), min_size=3, fold="last")).withColumnRenamed("value", "members")


@query()
def containment_fold(spark, d):
    sets = order_cover(spark, d).groupBy(F.col("comm_id").alias("pos")).agg(F.array_sort(F.collect_set("member")).alias("m"))
    return merge.ordered_fold(sets)


@query()
def cover_reduce(spark, d):
    return merge.reduce_covers(order_cover(spark, d), region_cover(spark, d))


@query(f"WITH {OVERLAPPING}, u AS (SELECT DISTINCT x.comm_id AS a, y.comm_id AS b FROM c x JOIN c y ON y.comm_id = x.comm_id + 1) SELECT a, b, (SELECT string_agg(CAST(member AS VARCHAR), '|' ORDER BY member) FROM (SELECT DISTINCT member FROM c WHERE comm_id IN (a, b))) AS members FROM u")
def sorted_union(spark, d):
    c = components.cut(order_cover(spark, d))
    ids = c.select(F.col("comm_id").alias("a")).distinct()
    pairs = ids.join(ids.select(F.col("a").alias("b")), F.col("b") == F.col("a") + 1)
    return merge.union_of(c, pairs).select("a", "b", F.array_join(F.col("members").cast("array<string>"), "|").alias("members"))


@query(f"WITH {OVERLAPPING}, n AS (SELECT comm_id FROM c GROUP BY 1 HAVING count(*) > 3) SELECT x.comm_id AS a, y.comm_id AS b FROM n x JOIN n y ON x.comm_id < y.comm_id")
def complete_meta_graph(spark, d):
    return merge.complete_meta_graph(order_cover(spark, d), 3)


@query(f"WITH {OVERLAPPING}, {PAIRS} SELECT a, b, shared, na, nb, round(shared / least(na, nb), 6) AS ratio FROM q")
def overlap_ratio_pairs(spark, d):
    return merge.overlap_pairs(order_cover(spark, d)).withColumn("ratio", F.round(F.col("shared") / F.least("na", "nb"), 6))


@query(f"""WITH {OVERLAPPING}, s AS (SELECT comm_id, list(member ORDER BY member) AS m FROM c GROUP BY 1), u AS (SELECT min(comm_id) AS comm_id, m FROM s GROUP BY m)
SELECT comm_id, unnest(m) AS member FROM u WHERE NOT EXISTS (SELECT 1 FROM u x WHERE x.comm_id <> u.comm_id AND len(x.m) > len(u.m) AND list_has_all(x.m, u.m))""")
def maximal_communities(spark, d):
    return merge.maximal(order_cover(spark, d))


@query("WITH s AS (SELECT o_custkey, list(DISTINCT month(o_orderdate) ORDER BY month(o_orderdate)) AS m FROM orders GROUP BY 1), u AS (SELECT min(o_custkey) AS comm_id, m FROM s GROUP BY m) SELECT comm_id, unnest(m)::BIGINT AS member FROM u")
def exact_dedup_cover(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("comm_id"), F.month("o_orderdate").cast("bigint").alias("member"))
    return merge.exact_dedup(o)


@query(f"WITH {OVERLAPPING}, {PAIRS} SELECT a, b, round(shared / (na + nb - shared), 6) AS jaccard FROM q WHERE shared / (na + nb - shared) > 0.2")
def jaccard_meta_graph(spark, d):
    return merge.meta_graph(order_cover(spark, d), 0.2).withColumn("jaccard", F.round("jaccard", 6))


_N = taylor_degree(HK_T, HK_EPS)


def _coefficients():
    p, a, b = psi(_N, HK_T), push_thresholds(_N, HK_T, HK_EPS), push_thresholds(_N, HK_T, HK_EPS, kdd=True)
    return [(j, p[j], a[j], b[j]) for j in range(_N)]


@query(f"""WITH RECURSIVE k AS (SELECT {_N} AS j, 1.0::DOUBLE AS p UNION ALL SELECT j - 1, 1 + p * {HK_T} / j FROM k WHERE j > 0)
SELECT CAST(j AS BIGINT) AS level, round(p, 6) AS psi, round(exp({HK_T}) * {HK_EPS} / ({_N} * p), 6) AS threshold, round((SELECT p FROM k WHERE j = 1) * {HK_EPS} / ({_N} * p), 6) AS kdd_threshold FROM k WHERE j < {_N}""")
def hk_coefficients(spark, d):
    rows = [(j, round(p, 6), round(a, 6), round(b, 6)) for j, p, a, b in _coefficients()]
    return spark.createDataFrame(rows, "level bigint, psi double, threshold double, kdd_threshold double")


def _hk_sql(kdd: bool = False, seeds: str = "d") -> str:
    out = [DEG, f"r0 AS MATERIALIZED (SELECT v AS seed, v, 1.0::DOUBLE AS r FROM {seeds})"]
    xs = []
    for j, (_, _, a, b) in enumerate(_coefficients()):
        bar = f"WHERE r >= deg * {(b if kdd else a)!r}" if j else ""
        out.append(f"v{j} AS MATERIALIZED (SELECT seed, r{j}.v, r, deg FROM r{j} JOIN d ON d.v = r{j}.v {bar})")
        xs.append(f"SELECT seed, v, r AS x FROM v{j}")
        out.append(f"r{j + 1} AS MATERIALIZED (SELECT seed, dst AS v, sum({HK_T / (j + 1)!r} * r / deg) AS r FROM v{j} JOIN e ON src = v{j}.v GROUP BY 1, 2)")
    xs.append(f"SELECT seed, v, r FROM r{_N}")
    out.append(f"y AS MATERIALIZED (SELECT seed, v, sum(x) AS x FROM ({' UNION ALL '.join(xs)}) GROUP BY 1, 2)")
    return ", ".join(out)


SWEEP = """rk AS MATERIALIZED (SELECT seed, v, deg, row_number() OVER (PARTITION BY seed ORDER BY round(x / deg / mx, 10) DESC, v) AS rank FROM (SELECT seed, y.v, deg, x, max(x) OVER (PARTITION BY seed) AS mx FROM y JOIN d ON d.v = y.v)),
er AS (SELECT a.seed, a.v, count(*) AS k FROM rk a JOIN e ON src = a.v JOIN rk b ON b.seed = a.seed AND b.v = dst AND b.rank < a.rank GROUP BY 1, 2),
sm AS (SELECT rk.seed, rank, sum(deg - 2 * coalesce(k, 0)) OVER w AS cut, sum(deg) OVER w AS volume, count(*) OVER (PARTITION BY rk.seed) AS support FROM rk LEFT JOIN er ON er.seed = rk.seed AND er.v = rk.v WINDOW w AS (PARTITION BY rk.seed ORDER BY rank)),
sc AS (SELECT *, CASE WHEN volume >= tot THEN 1.0 ELSE cut / least(volume, tot - volume) END AS conductance FROM sm, (SELECT count(*) AS tot FROM e)),
sw AS (SELECT seed, round(conductance, 6) AS conductance, CAST(cut AS BIGINT) AS cut, CAST(volume AS BIGINT) AS volume, support, rank AS size FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY conductance, rank) AS rn FROM sc) WHERE rn = 1)"""


def _all_seeds(e):
    return e.select(F.col("src").alias("seed"), F.col("src").alias("v")).distinct()


@query(f"WITH {trade_sql()}, {_hk_sql()} SELECT seed, v, round(x / exp({HK_T}), 9) AS x FROM y")
def hk_vector(spark, d):
    e = components.cut(nation_trade(spark, d))
    return diffusion.hk_vector(e, _all_seeds(e), HK_T, HK_EPS).withColumn("x", F.round(F.col("x") / math.exp(HK_T), 9))


@query(f"WITH {trade_sql()}, {_hk_sql(True)} SELECT seed, v, round(x / exp({HK_T}), 9) AS x FROM y")
def hk_vector_kdd(spark, d):
    e = components.cut(nation_trade(spark, d))
    return diffusion.hk_vector(e, _all_seeds(e), HK_T, HK_EPS, kdd=True).withColumn("x", F.round(F.col("x") / math.exp(HK_T), 9))


def _rounded(s):
    return s.select("seed", F.round("conductance", 6).alias("conductance"), F.col("cut").cast("bigint").alias("cut"), F.col("volume").cast("bigint").alias("volume"), "support", F.col("size").cast("bigint").alias("size"))


@query(f"WITH {trade_sql()}, {_hk_sql()}, {SWEEP} SELECT seed, conductance, cut, volume, support, CAST(size AS BIGINT) AS size FROM sw")
def hk_sweep(spark, d):
    e = components.cut(nation_trade(spark, d))
    return _rounded(diffusion.sweep(e, diffusion.hk_vector(e, _all_seeds(e), HK_T, HK_EPS))[0])


@query(f"WITH {trade_sql()}, {_hk_sql()} SELECT seed, v, round(x / exp({HK_T}), 9) AS x FROM y")
def hk_vector_queue(spark, d):
    e = components.cut(nation_trade(spark, d))
    return seedwise.hk_vector_exact(e, _all_seeds(e), HK_T, HK_EPS).select("seed", "v", F.round(F.col("x") / math.exp(HK_T), 9).alias("x"))


_HEAVY = "(SELECT v FROM d ORDER BY deg DESC, v LIMIT 10)"


@query(f"WITH {PARTS}, {_hk_sql(seeds=_HEAVY)}, {SWEEP} SELECT seed, conductance, cut, volume, support, CAST(size AS BIGINT) AS size FROM sw")
def hk_sweep_heavy_seeds(spark, d):
    e = components.cut(part_copurchase(spark, d))
    return _rounded(diffusion.sweep(e, diffusion.hk_vector(e, metrics.seed_sets(e, metrics.top_degree(e, 10)), HK_T, HK_EPS))[0])


@query(f"""WITH {PARTS}, {_hk_sql(seeds=_HEAVY)}, {SWEEP} SELECT round(avg(conductance), 6) AS mean_conductance, round(avg(size), 6) AS mean_size FROM sw""")
def mean_of_sweeps(spark, d):
    m = metrics.means(hk_sweep_heavy_seeds(spark, d), "conductance", "size")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(f"WITH {PARTS}, {DEG}, h AS (SELECT v FROM d ORDER BY deg DESC, v LIMIT 10) SELECT v AS seed, dst AS v FROM h JOIN e ON src = v UNION SELECT v, v FROM h")
def heavy_hood_seeds(spark, d):
    e = part_copurchase(spark, d)
    return metrics.seed_sets(e, metrics.top_degree(e, 10), hood=True)


@query()
def hk_vector_budget(spark, d):
    e = components.cut(nation_trade(spark, d))
    return seedwise.hk_vector_exact(e, _all_seeds(e), HK_T, HK_EPS, push_budget(e.select("src").distinct().count()))


@query()
def ppr_vector_queue(spark, d):
    e = components.cut(nation_trade(spark, d))
    return seedwise.ppr_vector_exact(e, _all_seeds(e))


@query()
def ppr_lazy_queue(spark, d):
    e = components.cut(nation_trade(spark, d))
    return seedwise.lazy_vector_exact(e, _all_seeds(e), 0.99, 1e-3)


@query()
def seed_report(spark, d):
    return diffusion.seed_report(components.cut(part_copurchase(spark, d)), 20)


@query()
def truth_evaluation(spark, d):
    e = components.cut(nation_trade(spark, d))
    return metrics.evaluate(e, region_cover(spark, d).withColumnRenamed("comm_id", "truth_id"), lambda g, s: diffusion.grow_once(g, s, 5.0))


@query()
def exponential_column(spark, d):
    e = components.cut(nation_trade(spark, d))
    return seedwise.exponential_columns(e, _all_seeds(e))


_HOP = f"""{DEG}, k AS (SELECT e.src AS s, dst AS v FROM e JOIN d x ON x.v = src JOIN d y ON y.v = dst WHERE {HK_T} / x.deg >= y.deg * {_coefficients()[1][2]!r} UNION SELECT v, v FROM d),
m AS (SELECT s, list(v ORDER BY v) AS m FROM k GROUP BY 1), u AS (SELECT min(s) AS comm_id, m FROM m GROUP BY m)"""


@query(f"WITH {trade_sql()}, {_HOP} SELECT comm_id, unnest(m) AS member FROM u WHERE NOT EXISTS (SELECT 1 FROM u x WHERE len(x.m) > len(u.m) AND list_has_all(x.m, u.m))")
def heat_kernel_cover_compat(spark, d):
    return diffusion.detect_hk(components.cut(nation_trade(spark, d)), HK_T, HK_EPS, compat=True)


@query()
def demon_local_async(spark, d):
    return demon.local_communities_async(part_copurchase(spark, d), vote="edge")


@query()
def hk_best_of_grid(spark, d):
    e = components.cut(nation_trade(spark, d))
    return diffusion.best_of_grid(e, _all_seeds(e), exact=True)


@query()
def ppr_best_of_grid(spark, d):
    e = components.cut(nation_trade(spark, d))
    return diffusion.best_of_grid(e, _all_seeds(e), diffusion.PPR_GRID, "ppr", exact=True)


@query()
def hk_best_of_grid_hood(spark, d):
    e = components.cut(part_copurchase(spark, d))
    return diffusion.best_of_grid(e, metrics.seed_sets(e, metrics.top_degree(e, 10)), neighbourhood=True, exact=True)


@query()
def heat_kernel_cover(spark, d):
    return diffusion.detect_hk(components.cut(nation_trade(spark, d)), HK_T, HK_EPS)


@query()
def heat_kernel_cover_ordered(spark, d):
    return diffusion.detect_hk(components.cut(nation_trade(spark, d)), HK_T, HK_EPS, ordered=True)


def _pagerank_sql(rounds: int) -> str:
    out = [DEG, "nn AS (SELECT count(*) AS n FROM d)", "x0 AS MATERIALIZED (SELECT v, 1.0 / n AS x FROM d, nn)"]
    for k in range(rounds):
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT d.v, 0.85 * coalesce(s, 0.0) + 0.15 / n AS x FROM d CROSS JOIN nn LEFT JOIN (SELECT dst, sum(x / deg) AS s FROM x{k} JOIN d ON d.v = x{k}.v JOIN e ON src = x{k}.v GROUP BY 1) g ON g.dst = d.v)")
    return ", ".join(out)


@query(f"WITH {PARTS}, {_pagerank_sql(10)} SELECT v, round(x, 9) AS x FROM x10")
def pagerank_power_k(spark, d):
    return diffusion.pagerank(part_copurchase(spark, d), 0.85, 10).withColumn("x", F.round("x", 9))


def _personal_sql(rounds: int) -> str:
    out = [DEG, "b AS MATERIALIZED (SELECT v, CASE WHEN v = (SELECT min(v) FROM d) THEN 1.0 ELSE 0.0 END::DOUBLE AS b FROM d)", "x0 AS MATERIALIZED (SELECT v, b AS x FROM b)"]
    for k in range(rounds):
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT b.v, 0.85 * coalesce(s, 0.0) + 0.15 * b AS x FROM b LEFT JOIN (SELECT dst, sum(x / deg) AS s FROM x{k} JOIN d ON d.v = x{k}.v JOIN e ON src = x{k}.v GROUP BY 1) g ON g.dst = b.v)")
    return ", ".join(out)


@query(f"WITH {PARTS}, {_personal_sql(20)} SELECT v, round(x / (SELECT sum(x) FROM x20), 9) AS x FROM x20")
def pagerank_personal(spark, d):
    e = components.cut(part_copurchase(spark, d))
    return diffusion.pagerank(e, 0.85, 20, personal=e.agg(F.min("src").alias("v")), normalize=True).withColumn("x", F.round("x", 9))


@query()
def ppr_sync_sweep(spark, d):
    e = components.cut(nation_trade(spark, d))
    return _rounded(diffusion.sweep(e, diffusion.ppr_vector(e, _all_seeds(e)).select("seed", "v", "x"))[0])


@query(f"WITH {trade_sql()}, {_hk_sql()}, s AS (SELECT DISTINCT seed FROM y) SELECT s.seed, d.v, round(coalesce(x, 0.0) / exp({HK_T}), 9) AS x FROM s CROSS JOIN d LEFT JOIN y ON y.seed = s.seed AND y.v = d.v")
def hk_vector_dense(spark, d):
    e = components.cut(nation_trade(spark, d))
    x = diffusion.dense(components.cut(diffusion.hk_vector(e, _all_seeds(e), HK_T, HK_EPS)), e.select(F.col("src").alias("v")).distinct())
    return x.withColumn("x", F.round(F.col("x") / math.exp(HK_T), 9))


@query("SELECT a AS alpha, round(1 / (1 - a), 6) AS rate FROM (SELECT unnest([0.85, 0.9, 0.99, 0.999])::DOUBLE AS a)")
def heat_time_of_alpha(spark, d):
    return spark.createDataFrame([(a, functions.heat_time(a)) for a in (0.85, 0.9, 0.99, 0.999)], "alpha double, t double").select("alpha", F.round(F.exp("t") / F.col("t"), 6).alias("rate"))


def _jacobi_sql(rounds: int) -> str:
    out = ["m AS MATERIALIZED (SELECT src AS i, dst AS j, -1.0::DOUBLE AS a FROM e)", "o AS MATERIALIZED (SELECT i, count(*) + 2.0 AS d, 1.0 + i % 5 AS b FROM m GROUP BY 1)", "x0 AS (SELECT i, 0.0::DOUBLE AS x FROM o)"]
    for k in range(rounds):
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT o.i, (b - coalesce(s, 0.0)) / d AS x FROM o LEFT JOIN (SELECT m.i, sum(a * x) AS s FROM m JOIN x{k} ON x{k}.i = m.j GROUP BY 1) t ON t.i = o.i)")
    return ", ".join(out)


@query(f"WITH {PARTS}, {_jacobi_sql(15)} SELECT i, round(x, 8) AS x FROM x15")
def jacobi_solver(spark, d):
    e = components.cut(part_copurchase(spark, d))
    deg = graph.degrees(e).select(F.col("v").alias("i"), F.col("v").alias("j"), (F.col("deg") + 2.0).alias("a"))
    matrix = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1.0).alias("a")).unionByName(deg)
    right = deg.select("i", (1.0 + F.col("i") % 5).alias("b"))
    return functions.jacobi(matrix, right, 15, 0.0).withColumn("x", F.round("x", 8))


@query("SELECT CAST(k AS BIGINT) AS k, round(0.15 * 0.85 ** k, 9) AS pr, round(exp(-5.0) * 5.0 ** k / gamma(k + 1), 9) AS hk FROM range(0, 20) t(k)")
def pathweight_curve(spark, d):
    k = F.col("id")
    fact = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda a, i: a * i)
    return spark.range(20).select(k.alias("k"), F.round(0.15 * F.pow(F.lit(0.85), k), 9).alias("pr"), F.round(F.exp(F.lit(-5.0)) * F.pow(F.lit(5.0), k) / fact, 9).alias("hk"))


@query(f"WITH {OVERLAPPING} SELECT member, count(*) AS n, round(1.0 / count(*), 6) AS alpha FROM c GROUP BY 1")
def belonging_weight(spark, d):
    return metrics.belonging(order_cover(spark, d)).withColumn("alpha", F.round("alpha", 6))


_F = {"max": "greatest(x.alpha, y.alpha)", "min": "least(x.alpha, y.alpha)", "mul": "x.alpha * y.alpha", "exp": "1.0 / ((1.0 + exp(2.0 - x.alpha)) * (1.0 + exp(2.0 - y.alpha)))"}


def _modularity(name: str):
    sql = f"""WITH {trade_sql()}, {OVERLAPPING}, {DEG}, al AS (SELECT member, 1.0 / count(*) AS alpha FROM c GROUP BY 1), a AS MATERIALIZED (SELECT comm_id, member, alpha, deg FROM c JOIN al USING (member) JOIN d ON v = member),
p AS MATERIALIZED (SELECT x.comm_id, src, dst, x.deg AS di, y.deg AS dj, {_F[name]} AS f FROM e JOIN a x ON x.member = src JOIN a y ON y.member = dst AND y.comm_id = x.comm_id),
t AS (SELECT *, sum(f) OVER (PARTITION BY comm_id, src) AS fo, sum(f) OVER (PARTITION BY comm_id, dst) AS fi FROM p), z AS (SELECT (SELECT count(*) FROM e) / 2 AS m, (SELECT count(*) FROM d) AS nv)
SELECT round(sum(f - di * dj * (fo / nv) * (fi / nv) / m) / any_value(m), 6) AS modularity FROM t, z WHERE f > 1e-4"""

    def run(spark, d):
        return metrics.modularity(nation_trade(spark, d), order_cover(spark, d), name).withColumn("modularity", F.round("modularity", 6))

    run.__name__ = f"modularity_{name}"
    query(sql)(run)


for _name in _F:
    _modularity(_name)


@query(f"WITH {trade_sql()}, {OVERLAPPING} SELECT (SELECT count(DISTINCT src) FROM e) AS n_nodes, (SELECT count(*) FROM e) // 2 AS n_edges, count(DISTINCT comm_id) AS n_communities, round(count(*) / count(DISTINCT comm_id), 6) AS avg_size, count(*) // count(DISTINCT comm_id) AS avg_size_floor FROM c")
def cover_report(spark, d):
    return metrics.cover_report(nation_trade(spark, d), order_cover(spark, d)).withColumn("avg_size", F.round("avg_size", 6))


@query(f"""WITH {OVERLAPPING}, t AS (SELECT n_regionkey::BIGINT AS truth_id, n_nationkey::BIGINT AS member FROM nation), k AS (SELECT truth_id, comm_id, count(*) AS k FROM c JOIN t USING (member) GROUP BY 1, 2),
s AS (SELECT truth_id, comm_id, k / (SELECT count(*) FROM c WHERE c.comm_id = k.comm_id) AS p, k / (SELECT count(*) FROM t WHERE t.truth_id = k.truth_id) AS r FROM k),
f AS (SELECT *, 2 * p * r / (p + r) AS f1 FROM s) SELECT truth_id, comm_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY truth_id ORDER BY f1 DESC, comm_id) AS rn FROM f) WHERE rn = 1""")
def prf1_vs_truth(spark, d):
    r = metrics.best_f1(order_cover(spark, d), region_cover(spark, d).withColumnRenamed("comm_id", "truth_id"))
    return r.select("truth_id", "comm_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {OVERLAPPING} SELECT comm_id, least(count(*), 25 - count(*)) AS small_side FROM c GROUP BY 1")
def size_smallside(spark, d):
    return metrics.small_side(order_cover(spark, d), 25)


@query(f"WITH {PARTS}, {DEG} SELECT v, deg FROM d ORDER BY deg DESC, v LIMIT 10")
def top_degree_seeds(spark, d):
    return metrics.top_degree(part_copurchase(spark, d), 10)


@query(f"WITH {PARTS}, {DEG} SELECT v, deg FROM (SELECT *, row_number() OVER (ORDER BY deg DESC, v) - 1 AS i FROM d) WHERE i % 20 = 0")
def stride_seeds(spark, d):
    return metrics.stride_by_degree(part_copurchase(spark, d), 20)


@query("WITH n AS (SELECT o_custkey AS t, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10) SELECT t AS truth_id FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM n) WHERE i % 10 = 0 AND i < 1000")
def test_community_selection(spark, d):
    return metrics.test_communities(table(spark, d, "orders").select(F.col("o_custkey").alias("truth_id"), F.col("o_orderkey").alias("member")))


@query("SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75 FROM lineitem GROUP BY 1")
def quartile_summary(spark, d):
    return metrics.quartiles(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")


@query(f"WITH {trade_sql()}, {REGIONS}, {_STATS}, v AS (SELECT comm_id, sum(deg) AS volume FROM c JOIN (SELECT src, count(*) AS deg FROM e GROUP BY 1) ON src = member GROUP BY 1), k AS (SELECT x.comm_id, count(*) AS cut FROM c x JOIN e ON src = x.member WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.comm_id = x.comm_id AND y.member = dst) GROUP BY 1) SELECT v.comm_id, round(coalesce(cut, 0) / least(volume, (SELECT count(*) FROM e) - volume), 6) AS conductance FROM v LEFT JOIN k USING (comm_id)")
def cover_conductance(spark, d):
    e = nation_trade(spark, d).withColumn("w", F.lit(1.0))
    s = cis.community_stats(e, region_cover(spark, d)).crossJoin(F.broadcast(e.agg(F.count("*").alias("t"))))  # one row
    return s.select("comm_id", F.round(conductance(F.col("w_out"), 2 * F.col("w_in") + F.col("w_out"), F.col("t")), 6).alias("conductance"))


@query()
def cis_expand(spark, d):
    return cis.expand_seeds(nation_trade(spark, d))


@query()
def cis_cover(spark, d):
    return cis.detect_cis(nation_trade(spark, d), 0.5)


@query()
def cis_cover_compat(spark, d):
    return cis.detect_cis(nation_trade(spark, d), 0.0, compat=True)


@query()
def hdemon_levels(spark, d):
    return demon.hdemon(components.cut(nation_trade(spark, d)))


def _chirikov_sql(nx: int, steps: int, k: float, eta: float, samples: int) -> str:
    draw = lambda salt: f"((((((id + {salt}) % 2147483647) * 48271 + 1) % 2147483647) * ((((id + {salt}) % 2147483647) * 48271 + 1) % 2147483647) % 2147483647) * 69621 % 2147483647)::DOUBLE / 2147483647"
    out = [f"a0 AS MATERIALIZED (SELECT id % {nx * nx} AS src, (id % {nx * nx} % {nx} + {draw(1)}) / {nx} AS x, (id % {nx * nx} // {nx} + {draw(7919)}) / {nx} AS p FROM (SELECT unnest(range({nx * nx * samples}))::BIGINT AS id))"]
    two_pi = 2 * math.pi
    for j in range(steps):
        out.append(f"b{j} AS (SELECT src, x, {eta!r} * p + {k / two_pi!r} * sin({two_pi!r} * x) AS q FROM a{j}), c{j} AS (SELECT src, x, q - floor(q) AS p FROM b{j}), a{j + 1} AS MATERIALIZED (SELECT src, x + p - floor(x + p) AS x, p FROM c{j})")
    return "WITH " + ", ".join(out) + f" SELECT src, (least(floor(x * {nx}), {nx - 1}) + {nx} * least(floor(p * {nx}), {nx - 1}))::BIGINT AS dst, count(*)::DOUBLE AS w FROM a{steps} GROUP BY 1, 2"


@query(_chirikov_sql(32, 10, 0.22, 0.99, 20))
def chirikov_edges(spark, d):
    return sources.chirikov(spark, 32, 32, 10, 0.22, 0.99, 20)


@query("SELECT o_custkey AS src, o_orderkey AS dst, 1.0::DOUBLE AS w FROM orders")
def comma_edge_parse(spark, d):
    sep = F.when(F.col("o_orderkey") % 2 == 0, ",").otherwise(" , ")
    return sources.plain_edges(table(spark, d, "orders").select(F.concat("o_custkey", sep, "o_orderkey").alias("value")))


def _names(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("idx"), (F.col("n_nationkey").cast("bigint") * 7 + 100).alias("name"))


@query("SELECT o_orderkey AS comm_id, unnest([o_custkey % 25, o_orderkey % 25])::BIGINT AS member FROM orders WHERE o_orderkey % 4 <> 0")
def result_list_parse(spark, d):
    o = table(spark, d, "orders")
    text = F.concat_ws(",", *(F.concat(((F.col(c) % 25) * 7 + 100).cast("string"), F.lit("("), (F.col(c) % 25).cast("string"), F.lit(")")) for c in ("o_custkey", "o_orderkey")))
    lines = o.select(F.when(F.col("o_orderkey") % 4 == 0, F.lit("Reduce Enabled")).otherwise(F.concat(text, F.lit(","))).alias("value"), F.col("o_orderkey").alias("pos"))
    head = spark.createDataFrame([("12(3),", -2), ("comm_size:9", -1)], "value string, pos long")
    return sources.member_lists(head.unionByName(lines), _names(spark, d), "pos")


@query("SELECT count(DISTINCT o_custkey)::BIGINT AS comm_size, 12.5::DOUBLE AS time_ms FROM orders")
def log_field_parse(spark, d):
    n = table(spark, d, "orders").select(F.countDistinct("o_custkey").alias("n"))
    rows = n.select(F.explode(F.array(F.concat(F.lit("comm size:"), "n"), F.lit("whole execution time:12.5 ms"), F.lit("name result:[[1]]"))).alias("value"))
    return sources.log_fields(rows)


_NAMES = "nm AS (SELECT n_nationkey::BIGINT AS idx, n_nationkey::BIGINT * 7 + 100 AS name FROM nation)"


@query(f"WITH {REGIONS}, {_NAMES} SELECT comm_id, name AS member FROM c JOIN nm ON idx = member")
def decode_cover(spark, d):
    return graph.decode(region_cover(spark, d), _names(spark, d))


@query(f"WITH {trade_sql()}, {_NAMES} SELECT x.name AS src, y.name AS dst, w FROM e JOIN nm x ON x.idx = src JOIN nm y ON y.idx = dst")
def encode_network(spark, d):
    names = _names(spark, d)
    return graph.encode_network(nation_trade(spark, d), names.select(F.col("name").alias("idx"), F.col("idx").alias("name")))


@query(f"""WITH {REGIONS}, {_NAMES} SELECT 'comm size:' || count(DISTINCT comm_id) AS value FROM c UNION ALL SELECT 'idx result:[[' || string_agg(CAST(member AS VARCHAR), ', ' ORDER BY member) || ']]' FROM c GROUP BY comm_id
UNION ALL SELECT 'name result:[[' || string_agg(CAST(name AS VARCHAR), ', ' ORDER BY name) || ']]' FROM c JOIN nm ON idx = member GROUP BY comm_id UNION ALL SELECT 'whole execution time:3 ms'""")
def result_write(spark, d):
    return sources.result_lines(region_cover(spark, d), _names(spark, d), 3)


@query(f"WITH {REGIONS}, {_NAMES} SELECT string_agg(name || '(' || idx || '),', '' ORDER BY idx) AS value FROM c JOIN nm ON idx = member GROUP BY comm_id")
def named_write(spark, d):
    return sources.named_lines(region_cover(spark, d), _names(spark, d))


@query(f"WITH {REGIONS} SELECT comm_id || chr(9) || '[' || string_agg(CAST(member AS VARCHAR), ', ' ORDER BY member) || ']' AS value, 1 AS level FROM c GROUP BY comm_id")
def numbered_write(spark, d):
    return sources.numbered_lines(region_cover(spark, d).withColumn("level", F.lit(1)))


@query(f"WITH {REGIONS}, s AS (SELECT list(member ORDER BY member) AS m FROM c GROUP BY comm_id) SELECT '[' || array_to_string(m, ', ') || ']' AS listed, '{{' || array_to_string(m, ', ') || '}}' AS a_set, '(' || array_to_string(m, ', ') || ')' AS a_tuple FROM s")
def pretty_print(spark, d):
    m = region_cover(spark, d).groupBy("comm_id").agg(F.array_sort(F.collect_set("member")).alias("m"))
    return m.select(sources.pretty(F.col("m")).alias("listed"), sources.pretty(F.col("m"), "set").alias("a_set"), sources.pretty(F.col("m"), "tuple").alias("a_tuple"))


@query(f"""WITH {trade_sql()}, {REGIONS}, {_STATS}, {_ENTITIES} SELECT en.comm_id, v, round({_density_sql('(n - 1)', '(w_in - ui)', '(w_out - uo + ui)', 0.0)} - {_density_sql('n', 'w_in', 'w_out', 0.0)}, 6) AS gain
FROM en JOIN st ON st.comm_id = en.comm_id JOIN c ON c.comm_id = en.comm_id AND c.member = v""")
def member_loss(spark, d):
    return cis.member_loss(nation_trade(spark, d), region_cover(spark, d)).withColumn("gain", F.round("gain", 6))
