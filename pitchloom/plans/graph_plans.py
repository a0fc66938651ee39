"""Queries over passing networks: centrality, team structure, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.operators import graph as G, identity as I, leaderboard as L, network as N
from pitchloom.plans.book import Book
from pitchloom.plans.sqlkit import CTES, NK, quoted, r, ratio, with_sql
from pitchloom.plans.stream_plans import passes
from pitchloom.runtime import staged
from pitchloom.sources.event_actions import read_lineup, read_table

BOOK = Book()
q = BOOK.add


def networks(spark, sf):
    return N.match_networks(passes(spark, sf))


def directory(spark, sf):
    return I.player_directory(read_lineup(spark, sf))


# --- SQL building blocks -----------------------------------------------------------------
CTES["links"] = (("edges",), f"""
SELECT {NK}, source, target, CAST(weight AS DOUBLE) AS w, 1e0 / weight AS d FROM edges""")
CTES["sizes"] = (("nodes",), f"SELECT {NK}, count(*) AS n FROM nodes GROUP BY {NK}")
CTES["degrees"] = (("nodes", "links"), f"""
SELECT n.{NK.replace(', ', ', n.')}, n.player_id, coalesce(i.k, 0) AS degree_in, coalesce(o.k, 0) AS degree_out,
  coalesce(i.k, 0) + coalesce(o.k, 0) AS degree_total, coalesce(i.s, 0) AS strength_in, coalesce(o.s, 0) AS strength_out
FROM nodes n
LEFT JOIN (SELECT game_id, team_id, target AS player_id, count(*) AS k, sum(w) AS s FROM links GROUP BY 1, 2, 3) i
  USING (game_id, team_id, player_id)
LEFT JOIN (SELECT game_id, team_id, source AS player_id, count(*) AS k, sum(w) AS s FROM links GROUP BY 1, 2, 3) o
  USING (game_id, team_id, player_id)""")


def _doubling(name, base, rounds=4):
    """Unrolled shortest-path doubling: paths of up to 2**rounds edges."""
    previous = base
    for step in range(1, rounds + 1):
        label = name if step == rounds else f"{name}_{step}"
        CTES[label] = ((previous,), f"""
SELECT game_id, team_id, a, b, min(d) AS d FROM (
  SELECT game_id, team_id, a, b, d FROM {previous}
  UNION ALL SELECT x.game_id, x.team_id, x.a, y.b, x.d + y.d FROM {previous} x JOIN {previous} y
    ON x.game_id = y.game_id AND x.team_id = y.team_id AND x.b = y.a AND x.a <> y.b) GROUP BY 1, 2, 3, 4""")
        previous = label


CTES["path_base"] = (("links",), "SELECT game_id, team_id, source AS a, target AS b, d FROM links")
_doubling("paths", "path_base")
CTES["pairs"] = (("links",), """
SELECT game_id, team_id, least(source, target) AS lo, greatest(source, target) AS hi, arg_max(w, source) AS w
FROM links GROUP BY 1, 2, 3, 4""")
CTES["two_way"] = (("pairs",), """
SELECT game_id, team_id, lo AS a, hi AS b, 1e0 / w AS d FROM pairs
UNION ALL SELECT game_id, team_id, hi, lo, 1e0 / w FROM pairs""")
_doubling("walks", "two_way")
CTES["ranks"] = (("nodes", "sizes", "links"), f"""
SELECT 0 AS step, game_id, team_id, player_id, 1e0 / n AS p FROM nodes JOIN sizes USING ({NK})
UNION ALL
SELECT step + 1, game_id, team_id, player_id,
  85e-2 * (got + lost / n) + (1 - 85e-2) / n
FROM (SELECT r.step, r.game_id, r.team_id, r.player_id, z.n,
    coalesce(g.got, 0) AS got, l.lost
  FROM ranks r JOIN sizes z USING (game_id, team_id)
  LEFT JOIN (SELECT f.game_id, f.team_id, f.target AS player_id, sum(t.p * f.w / o.s) AS got
    FROM links f JOIN ranks t ON t.game_id = f.game_id AND t.team_id = f.team_id AND t.player_id = f.source
    JOIN (SELECT game_id, team_id, source, sum(w) AS s FROM links GROUP BY 1, 2, 3 HAVING sum(w) > 0) o
      ON o.game_id = f.game_id AND o.team_id = f.team_id AND o.source = f.source GROUP BY 1, 2, 3) g
    ON g.game_id = r.game_id AND g.team_id = r.team_id AND g.player_id = r.player_id
  JOIN (SELECT t.game_id, t.team_id, sum(CASE WHEN o.source IS NULL THEN t.p ELSE 0 END) AS lost
    FROM ranks t LEFT JOIN (SELECT DISTINCT game_id, team_id, source FROM links WHERE w > 0) o
      ON o.game_id = t.game_id AND o.team_id = t.team_id AND o.source = t.player_id GROUP BY 1, 2) l
    ON l.game_id = r.game_id AND l.team_id = r.team_id
  WHERE r.step < 150)""")
CTES["triangles"] = (("pairs",), """
SELECT game_id, team_id, v AS player_id, sum(t) AS t FROM (
  SELECT x.game_id, x.team_id, unnest([x.lo, x.hi, y.hi]) AS v,
    coalesce(cbrt(x.w / nullif(m.top, 0)) * cbrt(y.w / nullif(m.top, 0)) * cbrt(z.w / nullif(m.top, 0)), 0) AS t
  FROM pairs x JOIN pairs y ON y.game_id = x.game_id AND y.team_id = x.team_id AND y.lo = x.hi
  JOIN pairs z ON z.game_id = x.game_id AND z.team_id = x.team_id AND z.lo = x.lo AND z.hi = y.hi
  JOIN (SELECT game_id, team_id, max(w) AS top FROM pairs GROUP BY 1, 2) m
    ON m.game_id = x.game_id AND m.team_id = x.team_id) GROUP BY 1, 2, 3""")
CTES["pair_degree"] = (("pairs",), """
SELECT game_id, team_id, v AS player_id, count(*) AS k FROM (
  SELECT game_id, team_id, unnest([lo, hi]) AS v FROM pairs) GROUP BY 1, 2, 3""")
CTES["team_shape"] = (("sizes", "degrees", "links"), f"""
SELECT {NK}, team_density, team_centralization, n AS team_n_nodes, m AS team_n_edges, w AS team_total_passes FROM (
  SELECT {NK}, any_value(z.n) AS n, CAST(sum(degree_out) AS BIGINT) AS m, CAST(sum(strength_out) AS DOUBLE) AS w,
    sum(degree_out) / nullif(CAST(any_value(z.n) * (any_value(z.n) - 1) AS DOUBLE), 0) AS team_density,
    CASE WHEN any_value(z.n) > 2 THEN (any_value(z.n) * max(degree_total) - sum(degree_total))
      / CAST((any_value(z.n) - 1) * (any_value(z.n) - 2) AS DOUBLE) END AS team_centralization
  FROM degrees JOIN sizes z USING ({NK}) GROUP BY {NK})""")
CTES["lineup"] = (("actions",), """
SELECT DISTINCT season, provider, player_id, CASE player_id % 100 WHEN 0 THEN 'GK' WHEN 1 THEN 'DEF' WHEN 2 THEN 'DEF'
  WHEN 3 THEN 'DEF' WHEN 4 THEN 'DEF' WHEN 5 THEN 'MID' WHEN 6 THEN 'MID' WHEN 7 THEN 'MID' ELSE 'FWD' END AS coarse_role
FROM actions WHERE player_id IS NOT NULL""")
_FAMILY = ("degree_in", "degree_out", "degree_total", "strength_in", "strength_out")


@q("edge_distance_e1", with_sql("links", f"SELECT {NK}, source, target, {r('d', 'distance')} FROM links"))
def edge_distance(spark, sf):
    return X.round_report(
        G.edge_distance(networks(spark, sf)[1]).select(*S.NETWORK_KEYS, "source", "target", "distance")
    )


@q("degree_strength_e2", with_sql("degrees", f"SELECT {NK}, player_id, {', '.join(_FAMILY)} FROM degrees"))
def degree_strength(spark, sf):
    return G.degree_strength(*networks(spark, sf))


CTES["hops"] = (("paths", "links"), """
SELECT 1 AS h, p.game_id, p.team_id, p.a, p.b, 1e0 AS c FROM paths p JOIN links l
  ON l.game_id = p.game_id AND l.team_id = p.team_id AND l.source = p.a AND l.target = p.b AND abs(l.d - p.d) <= 1e-9 + 1e-14 * p.d
UNION ALL
SELECT h + 1, game_id, team_id, a, b, sum(c) FROM (
  SELECT s.h, p.game_id, p.team_id, p.a, p.b, s.c FROM hops s
  JOIN links l ON l.game_id = s.game_id AND l.team_id = s.team_id AND l.source = s.b
  JOIN paths x ON x.game_id = s.game_id AND x.team_id = s.team_id AND x.a = s.a AND x.b = s.b
  JOIN paths p ON p.game_id = s.game_id AND p.team_id = s.team_id AND p.a = s.a AND p.b = l.target
    AND abs(x.d + l.d - p.d) <= 1e-9 + 1e-14 * p.d WHERE s.h < 12) GROUP BY h, game_id, team_id, a, b""")
CTES["ways"] = (("hops", "paths"), """
SELECT game_id, team_id, a, b, p.d, s.c FROM paths p JOIN (
  SELECT game_id, team_id, a, b, sum(c) AS c FROM hops GROUP BY 1, 2, 3, 4) s USING (game_id, team_id, a, b)""")
_BETWEEN = f"""
SELECT n.{NK.replace(', ', ', n.')}, n.player_id, {r('coalesce(c.credit, 0) / ((z.n - 1) * (z.n - 2))', 'betweenness')}
FROM nodes n JOIN sizes z USING ({NK}) LEFT JOIN (
  SELECT x.game_id, x.team_id, x.b AS player_id, sum(x.c * y.c / t.c) AS credit FROM ways x
  JOIN ways y ON y.game_id = x.game_id AND y.team_id = x.team_id AND y.a = x.b AND y.b <> x.a
  JOIN ways t ON t.game_id = x.game_id AND t.team_id = x.team_id AND t.a = x.a AND t.b = y.b
    AND abs(x.d + y.d - t.d) <= 1e-9 + 1e-14 * t.d GROUP BY 1, 2, 3) c USING (game_id, team_id, player_id)"""


@q("betweenness_e3", with_sql(["nodes", "sizes", "ways"], _BETWEEN))
def betweenness(spark, sf):
    return X.round_report(G.network_scores(*networks(spark, sf), measures=("betweenness",)))


@q("closeness_e4", with_sql(["nodes", "sizes", "paths"], f"""
SELECT n.{NK.replace(', ', ', n.')}, n.player_id,
  {r('coalesce(c.k / c.far * c.k / nullif(z.n - 1, 0), 0)', 'closeness')}
FROM nodes n JOIN sizes z USING ({NK}) LEFT JOIN (
  SELECT game_id, team_id, b AS player_id, count(*) AS k, sum(d) AS far FROM paths GROUP BY 1, 2, 3) c
  USING (game_id, team_id, player_id)"""))
def closeness(spark, sf):
    return X.round_report(G.network_scores(*networks(spark, sf), measures=("closeness",)))


# The leading left eigenvector, on its own way: the weights plus a shift are squared 26 times, so a start
# vector is pushed 2^26 steps. Classes are sets of nodes that reach each other (``reach`` holds
# every pair); the growth of a class is read off one more push of its own start vector.
CTES["reach_0"] = (("links",), "SELECT game_id, team_id, source AS a, target AS b FROM links WHERE w > 0")
for _step in range(4):
    CTES[f"reach_{_step + 1}"] = ((f"reach_{_step}",), f"""
SELECT * FROM reach_{_step} UNION SELECT x.game_id, x.team_id, x.a, y.b FROM reach_{_step} x JOIN reach_{_step} y
  ON x.game_id = y.game_id AND x.team_id = y.team_id AND x.b = y.a AND x.a <> y.b""")
CTES["eig_shift"] = (("nodes", "links"), f"""
SELECT n.game_id, n.team_id, n.player_id, max(coalesce(s.w, 0)) OVER (PARTITION BY n.game_id, n.team_id) / 2 AS s
FROM nodes n LEFT JOIN (SELECT game_id, team_id, target AS player_id, sum(w) AS w FROM links GROUP BY 1, 2, 3) s
  USING (game_id, team_id, player_id)""")
CTES["eig_matrix"] = (("eig_shift", "links"), """
SELECT game_id, team_id, a, b, sum(v) AS v FROM (
  SELECT game_id, team_id, source AS a, target AS b, w AS v FROM links
  UNION ALL SELECT game_id, team_id, player_id, player_id, s FROM eig_shift WHERE s > 0) GROUP BY 1, 2, 3, 4""")
CTES["eig_powers"] = (("eig_matrix",), """
SELECT 0 AS step, game_id, team_id, a, b, v FROM eig_matrix
UNION ALL
SELECT step + 1, game_id, team_id, a, b, v / max(v) OVER (PARTITION BY game_id, team_id) FROM (
  SELECT x.step, x.game_id, x.team_id, x.a, y.b, sum(x.v * y.v) AS v FROM eig_powers x
  JOIN eig_powers y ON y.game_id = x.game_id AND y.team_id = x.team_id AND y.a = x.b
  WHERE x.step < 26 GROUP BY 1, 2, 3, 4, 5)""")
CTES["eig_power"] = (("eig_powers",), "SELECT * FROM eig_powers WHERE step = 26")
CTES["eig_class"] = (("nodes", "reach_4"), f"""
SELECT n.game_id, n.team_id, n.player_id, least(n.player_id, coalesce(min(f.b), n.player_id)) AS class, count(f.b) AS others
FROM nodes n LEFT JOIN (SELECT f.game_id, f.team_id, f.a, f.b FROM reach_4 f
  JOIN reach_4 g ON g.game_id = f.game_id AND g.team_id = f.team_id AND g.a = f.b AND g.b = f.a) f
  ON f.game_id = n.game_id AND f.team_id = n.team_id AND f.a = n.player_id GROUP BY 1, 2, 3""")
# From each class (all ones on its members): what arrives at every node after 2^26 steps.
CTES["eig_arrived"] = (("eig_class", "eig_power"), """
SELECT c.game_id, c.team_id, c.class, p.b, sum(p.v) AS v FROM eig_class c
JOIN eig_power p ON p.game_id = c.game_id AND p.team_id = c.team_id AND p.a = c.player_id
WHERE c.others > 0 GROUP BY 1, 2, 3, 4""")
CTES["eig_growth"] = (("eig_arrived", "eig_class", "links"), """
SELECT game_id, team_id, class, sum(v * coalesce(w, 0)) / sum(v) AS g FROM (
  SELECT x.game_id, x.team_id, x.class, x.b, any_value(x.v) AS v, sum(l.w) AS w FROM eig_arrived x
  JOIN eig_class m ON m.game_id = x.game_id AND m.team_id = x.team_id AND m.player_id = x.b AND m.class = x.class
  LEFT JOIN (SELECT l.* FROM links l
    JOIN eig_class s ON s.game_id = l.game_id AND s.team_id = l.team_id AND s.player_id = l.source
    JOIN eig_class t ON t.game_id = l.game_id AND t.team_id = l.team_id AND t.player_id = l.target AND t.class = s.class) l
    ON l.game_id = x.game_id AND l.team_id = x.team_id AND l.source = x.b
  GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING sum(v) > 0""")
CTES["eig_leading"] = (("eig_growth",), """
SELECT * FROM (SELECT *, max(g) OVER (PARTITION BY game_id, team_id) AS top FROM eig_growth) WHERE g >= top * (1 - 1e-7)""")
CTES["eig_chosen"] = (("eig_leading", "reach_4"), """
SELECT game_id, team_id, min(class) AS class FROM eig_leading x WHERE NOT EXISTS (
  SELECT 1 FROM reach_4 p JOIN eig_leading y ON y.game_id = p.game_id AND y.team_id = p.team_id AND y.class = p.b
  WHERE p.game_id = x.game_id AND p.team_id = x.team_id AND p.a = x.class AND y.class <> x.class) GROUP BY 1, 2""")
CTES["eigen"] = (("eig_arrived", "eig_chosen"), """
SELECT game_id, team_id, b AS player_id, v / sqrt(sum(v * v) OVER (PARTITION BY game_id, team_id)) AS v
FROM eig_arrived JOIN eig_chosen USING (game_id, team_id, class)""")


@q("eigenvector_e5", with_sql(["nodes", "eig_chosen", "eigen"], f"""
SELECT {NK}, player_id, CASE WHEN c.class IS NOT NULL THEN {r('coalesce(v, 0)', 'x').removesuffix(' AS x')} END AS eigenvector
FROM nodes LEFT JOIN eig_chosen c USING (game_id, team_id) LEFT JOIN eigen USING (game_id, team_id, player_id)"""))
def eigenvector(spark, sf):
    return X.round_report(G.network_scores(*networks(spark, sf), measures=("eigenvector",)))


@q("pagerank_e6", with_sql(["nodes", "ranks"], f"""
SELECT n.{NK.replace(', ', ', n.')}, n.player_id, {r('t.p', 'pagerank')} FROM nodes n
JOIN ranks t USING (game_id, team_id, player_id) WHERE t.step = 150
  AND EXISTS (SELECT 1 FROM links l WHERE l.game_id = n.game_id AND l.team_id = n.team_id)
UNION ALL SELECT {NK}, player_id, NULL FROM nodes n
WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.game_id = n.game_id AND l.team_id = n.team_id)"""))
def pagerank(spark, sf):
    return X.round_report(G.network_scores(*networks(spark, sf), measures=("pagerank",)))


@q("clustering_e7", with_sql(["nodes", "triangles", "pair_degree"], f"""
SELECT n.{NK.replace(', ', ', n.')}, n.player_id, {r('coalesce(2 * t.t / (k.k * (k.k - 1)), 0)', 'clustering')}
FROM nodes n LEFT JOIN triangles t USING (game_id, team_id, player_id)
LEFT JOIN pair_degree k USING (game_id, team_id, player_id)"""))
def clustering(spark, sf):
    nodes, edges = networks(spark, sf)
    return X.round_report(G.clustering(nodes, edges, S.NETWORK_KEYS))


@q("density_e8", with_sql("team_shape", f"""
SELECT {NK}, team_n_nodes, team_n_edges, {r('team_density', 'team_density')}, team_total_passes FROM team_shape"""))
def density(spark, sf):
    return X.round_report(
        G.structure(*networks(spark, sf)).select(
            *S.NETWORK_KEYS, "team_n_nodes", "team_n_edges", "team_density", "team_total_passes"
        )
    )


@q("centralisation_e9", with_sql("team_shape", f"""
SELECT {NK}, {r('team_centralization', 'team_centralization')} FROM team_shape"""))
def centralisation(spark, sf):
    return X.round_report(
        G.structure(*networks(spark, sf)).select(*S.NETWORK_KEYS, "team_centralization")
    )


CTES["average_paths"] = (("nodes", "walks"), f"""
SELECT {NK}, total / (size * (size - 1)) AS team_avg_path_length FROM (
  SELECT {NK}, max(size) AS size, arg_max(total, (size, -low)) AS total FROM (
    SELECT {NK}, low, count(*) AS size, sum(far) AS total FROM (
      SELECT n.{NK.replace(', ', ', n.')}, least(n.player_id, coalesce(min(w.b), n.player_id)) AS low,
        coalesce(sum(w.d), 0) AS far FROM nodes n
      LEFT JOIN walks w ON w.game_id = n.game_id AND w.team_id = n.team_id AND w.a = n.player_id
      GROUP BY {', '.join('n.' + k for k in NK.split(', '))}, n.player_id) GROUP BY {NK}, low) GROUP BY {NK})
WHERE size > 1""")


@q("average_path_e10", with_sql("average_paths", f"""
SELECT {NK}, {r('team_avg_path_length', 'team_avg_path_length')} FROM average_paths"""))
def average_path(spark, sf):
    paths = G.average_path_length(*networks(spark, sf))
    return X.round_report(paths.withColumnRenamed("avg_path", "team_avg_path_length"))


@q("components_e10", with_sql(["nodes", "walks"], f"""
SELECT {', '.join('n.' + k for k in NK.split(', '))}, n.player_id, least(n.player_id, coalesce(min(w.b), n.player_id)) AS component
FROM nodes n LEFT JOIN walks w ON w.game_id = n.game_id AND w.team_id = n.team_id AND w.a = n.player_id
GROUP BY {', '.join('n.' + k for k in NK.split(', '))}, n.player_id"""))
def components(spark, sf):
    nodes, edges = networks(spark, sf)
    return G.components(staged(nodes), staged(edges))


CTES["credits"] = (("ways",), """
SELECT x.game_id, x.team_id, x.b AS player_id, sum(x.c * y.c / t.c) AS credit FROM ways x
JOIN ways y ON y.game_id = x.game_id AND y.team_id = x.team_id AND y.a = x.b AND y.b <> x.a
JOIN ways t ON t.game_id = x.game_id AND t.team_id = x.team_id AND t.a = x.a AND t.b = y.b
  AND abs(x.d + y.d - t.d) <= 1e-9 + 1e-14 * t.d GROUP BY 1, 2, 3""")
CTES["central"] = (("degrees", "sizes", "paths", "credits", "triangles", "pair_degree", "ranks", "eig_chosen", "eigen", "links"), f"""
SELECT g.{NK.replace(', ', ', g.')}, g.player_id, {', '.join('g.' + m for m in _FAMILY)},
  coalesce(b.credit, 0) / CASE WHEN z.n > 2 THEN (z.n - 1) * (z.n - 2) ELSE 1 END AS betweenness,
  coalesce(c.k / c.far * c.k / nullif(z.n - 1, 0), 0) AS closeness,
  CASE WHEN h.class IS NOT NULL THEN coalesce(v.v, 0) END AS eigenvector, CASE WHEN l.w > 0 THEN t.p END AS pagerank,
  coalesce(2 * y.t / nullif(k.k * (k.k - 1), 0), 0) AS clustering
FROM degrees g JOIN sizes z USING ({NK})
LEFT JOIN (SELECT game_id, team_id, b AS player_id, count(*) AS k, sum(d) AS far FROM paths GROUP BY 1, 2, 3) c
  USING (game_id, team_id, player_id)
LEFT JOIN credits b USING (game_id, team_id, player_id)
LEFT JOIN eig_chosen h USING (game_id, team_id) LEFT JOIN eigen v USING (game_id, team_id, player_id)
LEFT JOIN (SELECT game_id, team_id, sum(w) AS w FROM links GROUP BY 1, 2) l USING (game_id, team_id)
LEFT JOIN triangles y USING (game_id, team_id, player_id)
LEFT JOIN pair_degree k USING (game_id, team_id, player_id)
LEFT JOIN (SELECT * FROM ranks WHERE step = 150) t USING (game_id, team_id, player_id)""")


@q("centrality_players_e11", with_sql("central", f"""
SELECT {NK}, player_id, {', '.join(_FAMILY)}, {', '.join(r(m, m) for m in S.PLAYER_METRICS[5:])} FROM central"""))
def centrality_players(spark, sf):
    players, _ = G.centrality_table(*networks(spark, sf))
    return X.round_report(players)


@q("centrality_teams_e11", with_sql(["team_shape", "average_paths"], f"""
SELECT {NK}, {r('team_density', 'team_density')}, {r('team_centralization', 'team_centralization')},
  {r('team_avg_path_length', 'team_avg_path_length')}, team_n_nodes, team_n_edges, team_total_passes
FROM team_shape LEFT JOIN average_paths USING ({NK})"""))
def centrality_teams(spark, sf):
    teams = G.team_table(*networks(spark, sf))
    return X.round_report(teams.select(*S.NETWORK_KEYS, *S.TEAM_METRICS))


@q("top_customers_per_nation_e15", f"""
SELECT n_nationkey, c_custkey, {r('spend', 'spend', 2)}, place FROM (
  SELECT c_nationkey AS n_nationkey, c_custkey, spend,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY spend DESC, c_custkey) AS place
  FROM (SELECT o_custkey AS c_custkey, sum(l_extendedprice) AS spend FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) JOIN customer USING (c_custkey)) WHERE place <= 3""")
def top_customers(spark, sf):
    spend = (
        read_table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
        .join(read_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("l_extendedprice").alias("spend"))
        .join(read_table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    )
    best = L.top_per_group(spend, ["n_nationkey"], "spend", "c_custkey", 3)
    return X.round_report(best.select("n_nationkey", "c_custkey", "spend", "place"), 2)


def teams_of(spark, sf):
    """Club names come from the nations table: team n is nation n of its provider."""
    return read_table(spark, sf, "nation").select(
        F.explode(F.array(F.lit("alpha"), F.lit("beta"))).alias("provider"),
        F.col("n_nationkey").cast("long").alias("team_id"), F.col("n_name").alias("team_name"),
    ).where(F.col("team_id") != 2)


CTES["clubs"] = ((), """
SELECT p.provider, CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team_name FROM nation,
  (SELECT unnest(['alpha', 'beta']) AS provider) p WHERE n_nationkey <> 2""")


@q("team_structure_e19", with_sql(["team_shape", "average_paths", "clubs"], f"""
SELECT season, club, {r('avg(team_density)', 'team_density')}, {r('avg(team_centralization)', 'team_centralization')},
  {r('avg(team_avg_path_length)', 'team_avg_path_length')}, {r('avg(team_total_passes)', 'team_total_passes')}
FROM (SELECT s.*, p.team_avg_path_length, coalesce(c.team_name, 'team ' || s.team_id) AS club FROM team_shape s
  LEFT JOIN average_paths p USING ({NK}) LEFT JOIN clubs c USING (provider, team_id))
GROUP BY 1, 2 ORDER BY avg(team_total_passes) DESC, season, club LIMIT 12"""))
def team_structure(spark, sf):
    teams = G.team_table(*networks(spark, sf))
    return X.round_report(L.team_structure(I.club_labels(teams, teams_of(spark, sf))))


@q("club_pagerank_e20", with_sql(["nodes", "ranks"], f"""
SELECT n.{NK.replace(', ', ', n.')}, n.player_id, {r('coalesce(t.p, 0)', 'pagerank')} FROM nodes n
LEFT JOIN (SELECT * FROM ranks WHERE step = 150) t USING (game_id, team_id, player_id)"""))
def club_pagerank(spark, sf):
    scores = G.network_scores(*networks(spark, sf), measures=("pagerank",))
    return X.round_report(scores.fillna(0.0, ["pagerank"]))
