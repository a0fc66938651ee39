"""Season tables, leaderboards and their reports on all ten metrics, and both weightings of lanes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.operators import graph as G, leaderboard as L, network as N, threat as TH
from pitchloom.plans.book import Book
from pitchloom.plans.graph_plans import directory, networks
from pitchloom.plans.sqlkit import CTES, NK, r, with_sql
from pitchloom.plans.threat_plans import rated
from pitchloom.runtime import durable, staged
from pitchloom.sources import event_actions as E

BOOK = Book()
q = BOOK.add

METRICS = S.PLAYER_METRICS
THREAT = tuple(f"{m}_xt" for m in S.WEIGHT_SENSITIVE_METRICS)

# --- both weightings ---------------------------------------------------------------------

# Every building block of the ten metrics a second time, over lanes weighted by threat.
_BLOCKS = (
    "links degrees path_base paths_1 paths_2 paths_3 paths pairs ranks triangles hops ways credits reach_0 reach_1 "
    "reach_2 reach_3 reach_4 eig_shift eig_matrix eig_powers eig_power eig_class eig_arrived eig_growth eig_leading "
    "eig_chosen eigen central"
).split()
_WORD = re.compile(r"\b(" + "|".join(_BLOCKS) + r")\b")
for _name in _BLOCKS[1:]:
    _needs, _body = CTES[_name]
    CTES[f"xt_{_name}"] = (
        tuple(f"xt_{n}" if n in _BLOCKS else n for n in _needs), _WORD.sub(r"xt_\1", _body))
CTES["xt_links"] = (("xt_edges",), f"""
SELECT {NK}, source, target, xt_weight AS w, CASE WHEN xt_weight > 0 THEN 1e0 / xt_weight ELSE 1e12 END AS d FROM xt_edges""")
CTES["both_central"] = (("central", "xt_central"), f"""
SELECT c.*, {', '.join(f'x.{m} AS {m}_xt' for m in S.WEIGHT_SENSITIVE_METRICS)}
FROM central c JOIN xt_central x USING ({NK}, player_id)""")


def weighted_networks(spark, sf):
    """Nodes, and edges with pass counts and threat."""
    rows = staged(rated(spark, sf))
    nodes, edges = N.match_networks(rows)
    return staged(nodes), staged(TH.attach_threat(edges, rows))


# Betweenness by the rule of ``path_credit``: lanes are relaxed one by one, path counts follow the lanes that are
# tight as seen from a source, and each target's unit flows back over these same lanes. Where costs hold a
# worthless lane's 1e12, ties are wide, and counts from a middle player's own view would be others.
_HOPS = E.SQUAD - 1
_TIE = "<= 1e-9 + 1e-14 * p.d"
CTES["xt_legs"] = (("xt_links",), f"""
SELECT 1 AS h, game_id, team_id, source AS a, target AS b, d FROM xt_links
UNION ALL
SELECT h + 1, game_id, team_id, a, b, min(d) FROM (
  SELECT s.h, s.game_id, s.team_id, s.a, l.target AS b, s.d + l.d AS d FROM xt_legs s
  JOIN xt_links l ON l.game_id = s.game_id AND l.team_id = s.team_id AND l.source = s.b AND l.target <> s.a
  WHERE s.h < {_HOPS}) GROUP BY h, game_id, team_id, a, b""")
CTES["xt_least"] = (("xt_legs",), "SELECT game_id, team_id, a, b, min(d) AS d FROM xt_legs GROUP BY 1, 2, 3, 4")
CTES["xt_tight"] = (("xt_links", "xt_least"), f"""
SELECT l.game_id, l.team_id, l.source AS a, l.source AS u, l.target AS v FROM xt_links l
JOIN xt_least p ON p.game_id = l.game_id AND p.team_id = l.team_id AND p.a = l.source AND p.b = l.target
  AND abs(l.d - p.d) {_TIE}
UNION ALL
SELECT x.game_id, x.team_id, x.a, x.b, l.target FROM xt_least x
JOIN xt_links l ON l.game_id = x.game_id AND l.team_id = x.team_id AND l.source = x.b AND l.target <> x.a
JOIN xt_least p ON p.game_id = x.game_id AND p.team_id = x.team_id AND p.a = x.a AND p.b = l.target
  AND abs(x.d + l.d - p.d) {_TIE} AND x.d < p.d""")
CTES["xt_steps"] = (("xt_tight",), f"""
SELECT 1 AS h, game_id, team_id, a, v, 1e0 AS c FROM xt_tight WHERE u = a
UNION ALL
SELECT h + 1, game_id, team_id, a, v, sum(c) FROM (
  SELECT s.h, s.game_id, s.team_id, s.a, t.v, s.c FROM xt_steps s
  JOIN xt_tight t ON t.game_id = s.game_id AND t.team_id = s.team_id AND t.a = s.a AND t.u = s.v
  WHERE s.h < {_HOPS}) GROUP BY h, game_id, team_id, a, v""")
CTES["xt_counts"] = (("xt_steps",), "SELECT game_id, team_id, a, v, sum(c) AS c FROM xt_steps GROUP BY 1, 2, 3, 4")
CTES["xt_flows"] = (("xt_tight", "xt_counts"), f"""
SELECT 0 AS h, game_id, team_id, a, v, 1e0 AS m FROM xt_counts
UNION ALL
SELECT h + 1, game_id, team_id, a, v, sum(m) FROM (
  SELECT f.h, f.game_id, f.team_id, f.a, t.u AS v, f.m * x.c / y.c AS m FROM xt_flows f
  JOIN xt_tight t ON t.game_id = f.game_id AND t.team_id = f.team_id AND t.a = f.a AND t.v = f.v AND t.u <> t.a
  JOIN xt_counts x ON x.game_id = f.game_id AND x.team_id = f.team_id AND x.a = f.a AND x.v = t.u
  JOIN xt_counts y ON y.game_id = f.game_id AND y.team_id = f.team_id AND y.a = f.a AND y.v = f.v
  WHERE f.h < {_HOPS}) GROUP BY h, game_id, team_id, a, v""")
CTES["xt_shares"] = (("xt_flows",), """
SELECT game_id, team_id, v AS player_id, sum(m) AS credit FROM xt_flows WHERE h > 0 GROUP BY 1, 2, 3""")
_needs, _body = CTES["xt_central"]
CTES["xt_central_shares"] = (
    tuple(n.replace("xt_credits", "xt_shares") for n in _needs), _body.replace("xt_credits", "xt_shares"))
CTES["both_central_shares"] = (("central", "xt_central_shares"), CTES["both_central"][1].replace("xt_central", "xt_central_shares"))


# Shares such as 243 / 640 lie half-way between two values of six digits, and rounding noise would decide: ten
# digits take the noise away first, and a decimal keeps what is half-way exactly there.
def _settled_sql(name):
    return f"CAST(round(CAST({name} AS DECIMAL(28, 10)), 6) AS DOUBLE) + 0 AS {name}"


def settled_report(df):
    """Every floating column rounded to ten digits and then, half-way cases up, to six."""
    return df.select(*(
        (F.round(F.col(name).cast("decimal(28,10)"), 6).cast("double") + 0.0).alias(name) if kind == "double" else F.col(name)
        for name, kind in df.dtypes))


@q("centrality_weightings_e11", with_sql("both_central_shares", f"""
SELECT {NK}, player_id, {', '.join(map(_settled_sql, (*METRICS[5:], *THREAT)))} FROM both_central_shares"""))
def centrality_weightings(spark, sf):
    table = G.both_weightings(*weighted_networks(spark, sf))
    return settled_report(table.select(*S.NETWORK_KEYS, "player_id", *METRICS[5:], *THREAT))


# --- the season table --------------------------------------------------------------------

def _season(source, metrics):
    return f"""
SELECT season, provider, player_id, coarse_role, {', '.join(f'avg(d.{m}) AS {m}' for m in metrics)},
  avg(n.mean_x) AS mean_x, avg(n.mean_y) AS mean_y, count(*) AS n_matches
FROM {source} d JOIN nodes n USING ({NK}, player_id) LEFT JOIN lineup USING (season, provider, player_id)
GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5"""


CTES["season_table"] = (("central", "nodes", "lineup"), _season("central", METRICS))
CTES["season_both"] = (("both_central", "nodes", "lineup"), _season("both_central", (*METRICS, *THREAT)))


def _with_roles(spark, sf, players, nodes, metrics):
    players = players.join(
        nodes.select(*S.NETWORK_KEYS, "player_id", "mean_x", "mean_y"), [*S.NETWORK_KEYS, "player_id"])
    table = L.player_season(players, metrics=(*metrics, "mean_x", "mean_y"))
    roles = directory(spark, sf).select("season", "provider", "player_id", "coarse_role")
    return table.join(roles, ["season", "provider", "player_id"], "left")


def season_table(spark, sf):
    nodes, edges = networks(spark, sf)
    return _with_roles(spark, sf, G.centrality_table(nodes, edges)[0], nodes, METRICS)


@q("player_season_e12", with_sql("season_table", f"""
SELECT season, provider, player_id, {', '.join(r(m, m) for m in (*METRICS, 'mean_x', 'mean_y'))}, n_matches
FROM season_table"""))
def player_season(spark, sf):
    return X.round_report(season_table(spark, sf).drop("coarse_role"))


def _z(source, metrics):
    return f"""
SELECT *, {', '.join(f"coalesce(({m} - avg({m}) OVER w) / nullif(stddev_pop({m}) OVER w, 0), 0) AS {m}_z" for m in metrics)}
FROM {source} WINDOW w AS (PARTITION BY coarse_role)"""


CTES["season_z"] = (("season_table",), _z("season_table", METRICS))


@q("role_relative_e13", with_sql("season_z", f"""
SELECT season, provider, player_id, coarse_role, {', '.join(r(m + '_z', m + '_z') for m in METRICS)} FROM season_z"""))
def role_relative(spark, sf):
    table = L.role_relative(season_table(spark, sf))
    return X.round_report(
        table.select("season", "provider", "player_id", "coarse_role", *[m + "_z" for m in METRICS])
    )


# --- position residuals ------------------------------------------------------------------

# Least squares on [1, x, y, xx, yy, xy] by making each term orthogonal to those before, in every
# group and metric; what is left of the metric after all six is its residual.
_TERMS = ("1e0", "x", "y", "x * x", "y * y", "x * y")


def _long(source, metrics):
    return " UNION ALL ".join(
        f"SELECT season, provider, player_id, coarse_role, n_matches, '{m}' AS metric, {m} AS v, zx AS x, zy AS y FROM {source}" for m in metrics)


def _residual_ctes(prefix, source, metrics):
    CTES[f"{prefix}_placed"] = ((source,), f"""
SELECT *, (mean_x - avg(mean_x) OVER g) / coalesce(nullif(stddev_pop(mean_x) OVER g, 0), 1) AS zx,
  (mean_y - avg(mean_y) OVER g) / coalesce(nullif(stddev_pop(mean_y) OVER g, 0), 1) AS zy
FROM {source} WINDOW g AS (PARTITION BY season, provider)""")
    CTES[f"{prefix}_o0"] = ((f"{prefix}_placed",), f"""
SELECT *, {', '.join(f'{term} AS t{k}' for k, term in enumerate(_TERMS))} FROM ({_long(f'{prefix}_placed', metrics)}) WHERE v IS NOT NULL""")
    group = "WINDOW g AS (PARTITION BY season, provider, metric)"

    def less(column, upto):
        # Twice, as one pass leaves rounding behind.
        return f"{column}" + "".join(
            f" - coalesce(sum({column} * q{j}) OVER g / nullif(sum(q{j} * q{j}) OVER g, 0), 0) * q{j}" for j in range(upto))

    for k in range(6):
        CTES[f"{prefix}_o{k + 1}"] = ((f"{prefix}_o{k}",), f"""
SELECT * EXCLUDE (u), {less('u', k)} AS q{k} FROM (SELECT *, {less(f't{k}', k)} AS u FROM {prefix}_o{k} {group}) {group}""")
    CTES[f"{prefix}_left"] = ((f"{prefix}_o6",), f"""
SELECT *, count(*) OVER g AS n, max(v) OVER g - min(v) OVER g <= 1e-12 * max(abs(v)) OVER g AS flat, {less('v', 6)} AS left_ FROM {prefix}_o6 {group}""")
    CTES[f"{prefix}_resid"] = ((f"{prefix}_left",), f"""
SELECT season, provider, player_id, coarse_role, n_matches, metric, v, n, n < 6 OR flat AS none,
  CASE WHEN n < 6 OR flat THEN 0 ELSE left_ END AS res FROM {prefix}_left""")
    CTES[f"{prefix}_r2"] = ((f"{prefix}_resid",), """
SELECT season, provider, metric, CASE WHEN any_value(none) THEN 0 ELSE 1 - sum(res * res) / (var_pop(v) * count(*)) END AS r2, count(*) AS n
FROM {0}_resid GROUP BY 1, 2, 3""".format(prefix))


_residual_ctes("pos", "season_table", METRICS)


@q("position_residual_e14", with_sql(["season_table", "pos_resid"], f"""
SELECT season, provider, player_id, {', '.join(f"coalesce(max(CASE WHEN metric = '{m}' THEN round(res, 6) + 0 END), 0) AS {m}_r" for m in METRICS)}
FROM season_table LEFT JOIN pos_resid USING (season, provider, player_id) GROUP BY 1, 2, 3"""))
def position_residual(spark, sf):
    frame, _ = L.position_residual(season_table(spark, sf))
    return X.round_report(frame.select("season", "provider", "player_id", *[m + "_r" for m in METRICS]))


@q("position_r2_e14", with_sql("pos_r2", f"SELECT season, provider, metric, {r('r2', 'r2')}, n FROM pos_r2"))
def position_r2(spark, sf):
    return X.round_report(L.position_residual(season_table(spark, sf))[1])


# --- leaderboards ------------------------------------------------------------------------

_residual_ctes("lead", "season_both", METRICS)
CTES["lead_z"] = (("season_both",), _z("season_both", METRICS))
CTES["lead_all"] = (("lead_z", "lead_resid"), " UNION ALL ".join(
    [f"SELECT '{m}' AS metric, '{basis}' AS basis, season, provider, player_id, coarse_role, n_matches, {m}{basis} AS v FROM lead_z"
     for basis, names in (("", METRICS), ("_z", METRICS), ("_xt", S.WEIGHT_SENSITIVE_METRICS)) for m in names]
    + ["SELECT metric, '_r', season, provider, player_id, coarse_role, n_matches, res FROM lead_resid"]))


@q("leaderboard_e15", with_sql("lead_all", f"""
SELECT metric, basis, place, season, provider, player_id, coarse_role, n_matches, {r('v', 'value')} FROM (
  SELECT *, row_number() OVER (PARTITION BY metric, basis ORDER BY round(v, 6) DESC, player_id, season, provider) AS place
  FROM lead_all WHERE v IS NOT NULL) WHERE place <= 20"""))
def leaderboards(spark, sf):
    """Top 20 of every metric in every basis, in one plan."""
    nodes, edges = weighted_networks(spark, sf)
    table = durable(_with_roles(spark, sf, G.both_weightings(nodes, edges), nodes, (*METRICS, *THREAT)))
    scaled = L.role_relative(table)
    residual = L.position_residual(scaled)[0]
    # A player without the metric has no residual to be ranked on.
    held = residual.withColumns({f"{m}_r": F.when(F.col(m).isNotNull(), F.col(f"{m}_r")) for m in METRICS})
    return L.leaderboards(X.round_report(held), METRICS, 20)


@q("leaderboard_role_e15", with_sql("season_z", f"""
SELECT season, provider, player_id, coarse_role, {r('pagerank_z', 'pagerank_z')}, n_matches FROM season_z
WHERE coarse_role = 'DEF' AND n_matches >= 6 ORDER BY round(pagerank_z, 6) DESC, player_id, season LIMIT 20"""))
def leaderboard_role(spark, sf):
    table = X.round_report(L.role_relative(season_table(spark, sf), metrics=("pagerank",)))
    best = L.leaderboard(table, "pagerank", 20, role="DEF", min_matches=6, basis="_z")
    return best.select("season", "provider", "player_id", "coarse_role", "pagerank_z", "n_matches")


# --- reports -----------------------------------------------------------------------------

_ROLE_SHARES = ", ".join(
    r(f"coalesce(100e0 * count(*) FILTER (coarse_role = '{c}') / nullif(count(coarse_role), 0), 0)", f"pct_{c}")
    for c in S.COARSE_ROLES
)
_VALUES = "(" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, player_id, season, provider, coarse_role, {m} AS v FROM season_table" for m in METRICS
) + ")"
_COMPOSITION = f"""
SELECT metric, {_ROLE_SHARES} FROM (SELECT *, row_number() OVER (
  PARTITION BY metric ORDER BY v DESC, player_id, season, provider) AS p FROM {_VALUES} WHERE v IS NOT NULL) WHERE p <= 50 GROUP BY metric
UNION ALL SELECT 'population', {_ROLE_SHARES} FROM season_table"""


@q("role_composition_e16", with_sql("season_table", _COMPOSITION))
def role_composition(spark, sf):
    return X.round_report(L.role_composition(season_table(spark, sf), METRICS))


CTES["ranked"] = (("season_table",), "SELECT season, provider, player_id, " + ", ".join(
    f"CASE WHEN {m} IS NOT NULL THEN rank() OVER (ORDER BY {m} NULLS LAST) + (count(*) OVER (PARTITION BY {m}) - 1) / 2e0 END AS {m}" for m in METRICS
) + f" FROM (SELECT season, provider, player_id, {', '.join(f'round({m}, {L.RANK_DIGITS}) AS {m}' for m in METRICS)} FROM season_table)")
_PAIRS = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1:]]
CTES["spearman"] = (("ranked",), " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM ranked" for a, b in _PAIRS))


@q("spearman_pairs_e17", with_sql("spearman", f"SELECT a AS \"left\", b AS \"right\", {r('rho', 'spearman')} FROM spearman"))
def spearman_pairs(spark, sf):
    return X.round_report(L.spearman_pairs(season_table(spark, sf), METRICS))


@q("mean_spearman_e17", with_sql("spearman", f"SELECT {r('avg(rho)', 'mean_spearman')}, count(*) AS pairs FROM spearman"))
def mean_spearman(spark, sf):
    return X.round_report(L.mean_pairwise_spearman(season_table(spark, sf), METRICS))


@q("volume_proxy_report_e18", with_sql(["season_table", "spearman", "pos_r2"], f"""
SELECT c.*, s.rho_volume, e.mean_r2 FROM ({_COMPOSITION}) c LEFT JOIN (
  SELECT CASE WHEN a = 'degree_total' THEN b ELSE a END AS metric, {r('rho', 'rho_volume')} FROM spearman
  WHERE a = 'degree_total' OR b = 'degree_total') s USING (metric)
LEFT JOIN (SELECT metric, {r('avg(r2)', 'mean_r2')} FROM pos_r2 GROUP BY 1) e USING (metric)"""))
def volume_proxy(spark, sf):
    table = durable(season_table(spark, sf))
    return X.round_report(L.volume_proxy_report(table, L.position_residual(table)[1], METRICS))
