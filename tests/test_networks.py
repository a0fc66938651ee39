import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import frames
from pitchloom import schema as S
from pitchloom.operators import features as FE, graph as G, leaderboard as L, network as N, sequence as Q

KEYS = ["game_id", "team_id", "season", "provider"]


def edges_of(df):
    return {(r["source"], r["target"]): r["weight"] for r in df.collect()}


def test_match_network(spark):
    nodes, edges = N.match_networks(Q.infer_recipients(frames.actions(spark, frames.game_network(spark))))
    assert edges_of(edges.where("team_id = 1")) == {(10, 20): 2, (20, 30): 2, (30, 10): 1}
    row = nodes.where("player_id = 10").first()
    assert row["mean_x"] == pytest.approx(22.5) and row["passes_completed"] == 2


def test_minutes_filter(spark):
    rows = frames.game_network(spark) + [dict(player_id=77, time_seconds=2600.0)]
    df = Q.infer_recipients(frames.actions(spark, rows))
    assert N.match_networks(df)[0].where("player_id = 77").isEmpty()
    assert not N.match_networks(df, min_minutes=0)[0].where("player_id = 77").isEmpty()
    assert Q.player_minutes(df).where("player_id = 77").first()["minutes_played"] == 0.0


def test_window_bounds_and_membership(spark):
    bounds = [(r["low"], r["high"]) for r in N.window_bounds(spark).orderBy("window_index").collect()]
    assert len(bounds) == 16 and bounds[0] == (0, 15) and bounds[1] == (5, 20) and bounds[-1] == (75, 90)
    minutes = [0.0, 4.9, 5.0, 14.99, 15.0, 44.9, 74.9, 75.0, 89.99, 90.0, 93.0]
    rows = [dict(time_seconds=m * 60) for m in minutes]
    got = {}
    for r in N.assign_windows(frames.actions(spark, rows)).collect():
        got.setdefault(round(r["time_seconds"] / 60, 2), set()).add(r["window_index"])
    for m in minutes:
        assert got.get(m, set()) == {i for i, (lo, hi) in enumerate(bounds) if lo <= m < hi}, m


def test_single_action_player_has_zero_spread(spark):
    row = N.node_table(frames.actions(spark, [{}])).first()
    assert row["spread_x"] == 0.0


# --- graph measures against plain definitions --------------------------------------------


def random_network(spark, seed, n=7, games=2):
    rng = random.Random(seed)
    nodes, edges = [], []
    for game in range(games):
        for p in range(n + game):
            nodes.append((game, 1, "s", "p", p, rng.random()))
        for a in range(n + game):
            for b in range(n + game):
                if a != b and rng.random() < 0.35:
                    edges.append((game, 1, "s", "p", a, b, rng.randint(1, 4)))
    key = "game_id long, team_id long, season string, provider string"
    return (
        spark.createDataFrame(nodes, f"{key}, player_id long, mean_x double"),
        spark.createDataFrame(edges, f"{key}, source long, target long, weight long"),
        nodes, edges,
    )


def brute_paths(players, cost):
    """All shortest-path costs and every shortest path, by exhaustive search."""
    best, paths = {}, {}

    def walk(start, at, total, seen):
        for (a, b), c in cost.items():
            if a == at and b not in seen:
                t = total + c
                key = (start, b)
                if t < best.get(key, math.inf) - 1e-9:
                    best[key], paths[key] = t, [seen + [b]]
                elif abs(t - best[key]) <= 1e-9:
                    paths[key].append(seen + [b])
                walk(start, b, t, seen + [b])

    for p in players:
        walk(p, p, 0.0, [p])
    return best, paths


@pytest.mark.parametrize("seed", [1, 4])
def test_scores_against_brute_force(spark, seed):
    nodes, edges, raw_nodes, raw_edges = random_network(spark, seed, n=6, games=1)
    got = {r["player_id"]: r for r in G.network_scores(nodes, edges).collect()}
    players = [r[4] for r in raw_nodes]
    n = len(players)
    cost = {(e[4], e[5]): 1.0 / e[6] for e in raw_edges}
    best, paths = brute_paths(players, cost)
    for v in players:
        far = [best[(u, v)] for u in players if (u, v) in best]
        wanted = len(far) / sum(far) * len(far) / (n - 1) if far else 0.0
        assert got[v]["closeness"] == pytest.approx(wanted)
        through = sum(
            sum(v in p[1:-1] for p in ps) / len(ps) for (s, t), ps in paths.items() if v not in (s, t)
        )
        assert got[v]["betweenness"] == pytest.approx(through / ((n - 1) * (n - 2)))
    # PageRank and eigenvector: the defining equations hold.
    w = np.zeros((n, n))
    for e in raw_edges:
        w[e[4], e[5]] = e[6]
    out = w.sum(axis=1)
    rank = np.array([got[p]["pagerank"] for p in players])
    flow = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    assert rank.sum() == pytest.approx(1.0)
    assert np.allclose(rank, 0.85 * (rank @ flow + rank[out == 0].sum() / n) + 0.15 / n, atol=1e-8)
    vector = np.array([got[p]["eigenvector"] for p in players])
    assert (vector >= 0).all()
    image = w.T @ vector
    scale = image @ vector
    assert np.allclose(image, scale * vector, atol=1e-6) and np.linalg.norm(vector) == pytest.approx(1.0)


@pytest.mark.parametrize("cells", [1, 60, 200])
def test_block_size_does_not_matter(spark, cells):
    """One source a block, a few, or networks side by side: the same numbers."""
    nodes, edges, _, _ = random_network(spark, 8, n=9, games=3)
    measures = (*G.SCORES, "paths")

    def table(size):
        rows = G.node_measures(nodes, edges, KEYS, measures=measures, cells=size).collect()
        assert len(rows) == len({(r["game_id"], r["player_id"]) for r in rows}) == 30
        return {(r["game_id"], r["player_id"]): [r[m] for m in (*G.SCORES, "component", "path_total")] for r in rows}

    whole, cut = table(10**6), table(cells)
    for key, values in whole.items():
        assert cut[key] == pytest.approx(values, rel=1e-9, abs=1e-9), key
    path = {r["game_id"]: r["avg_path"] for r in G.average_path_length(nodes, edges, KEYS, cells).collect()}
    assert path == pytest.approx({r["game_id"]: r["avg_path"] for r in G.average_path_length(nodes, edges, KEYS).collect()})


def lanes_of(spark, lanes, players=()):
    key = "game_id long, team_id long, season string, provider string"
    ids = sorted({p for a, b, _ in lanes for p in (a, b)} | set(players))
    return (
        spark.createDataFrame([(1, 1, "s", None, p) for p in ids], f"{key}, player_id long"),
        spark.createDataFrame([(1, 1, "s", None, a, b, w) for a, b, w in lanes], f"{key}, source long, target long, weight long"),
    )


def vector_of(spark, lanes, players=(), cells=10**6):
    rows = G.network_scores(*lanes_of(spark, lanes, players), KEYS, measures=("eigenvector",), cells=cells).collect()
    return {r["player_id"]: r["eigenvector"] for r in rows}


def both(a, b, w=1):
    return [(a, b, w), (b, a, w)]


def test_equal_blocks_give_the_block_of_the_smallest_id(spark):
    for cells in (1, 10**6):
        assert vector_of(spark, both(3, 4) + both(1, 2), cells=cells) == pytest.approx({1: 0.5**0.5, 2: 0.5**0.5, 3: 0, 4: 0})
    # The first block feeds the second, which grows alike: only the second carries a vector.
    fed = vector_of(spark, both(1, 2) + [(2, 3, 5)] + both(3, 4))
    assert fed == pytest.approx({1: 0, 2: 0, 3: 0.5**0.5, 4: 0.5**0.5})
    # The faster block leads and reaches a slower one and a dead end: v3 = (2 v2 + v4) / 3, v4 = v3 / 3.
    led = vector_of(spark, both(1, 2, 3) + [(2, 3, 2)] + both(3, 4) + [(4, 5, 1)], [9])
    assert led[1] == pytest.approx(led[2]) and led[9] == 0
    assert 3 * led[3] == pytest.approx(2 * led[2] + led[4]) and 3 * led[4] == pytest.approx(led[3])
    assert 3 * led[5] == pytest.approx(led[4])


def test_networks_without_circles_have_no_eigenvector(spark):
    assert vector_of(spark, [(1, 2, 1), (2, 3, 4)]) == {1: None, 2: None, 3: None}
    scores = G.network_scores(*lanes_of(spark, [(1, 2, 0)], [3]), KEYS).collect()
    assert all(r["pagerank"] is None and r["eigenvector"] is None for r in scores)


def test_long_circles_and_paths(spark):
    """Longer than one Krylov subspace, and as deep as it is long."""
    n = 300
    ring = [(v, (v + 1) % n, 1 + v % 3) for v in range(n)] + [(v, (v * 7 + 3) % n, 1) for v in range(n)]
    got = vector_of(spark, ring, cells=20_000)
    weight = np.zeros((n, n))
    for a, b, w in ring:
        weight[a, b] += w
    v = np.array([got[p] for p in range(n)])
    grown = v @ weight
    assert np.allclose(grown, (grown @ v) * v, atol=1e-7) and np.linalg.norm(v) == pytest.approx(1.0)
    path = G.node_measures(*lanes_of(spark, [(v, v + 1, 1) for v in range(n)]), KEYS, measures=("betweenness", "paths")).collect()
    middle = {r["player_id"]: r for r in path}
    assert middle[100]["betweenness"] == pytest.approx(100 * 200 / (300 * 299)) and middle[100]["component"] == 0
    assert middle[0]["path_total"] == 300 * 301 / 2


def test_components_settle_on_long_paths(spark):
    keys, n = ["game_id"], 10_000
    nodes = spark.range(n + 5).select(F.lit(1).alias("game_id"), F.col("id").alias("player_id"))
    # Neighbours on the path are far apart in id.
    hop = lambda c: (c * 7919) % n
    edges = spark.range(n - 1).select(F.lit(1).alias("game_id"), hop(F.col("id")).alias("source"), hop(F.col("id") + 1).alias("target"))
    found = G.components(nodes, edges, keys).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in found} == {0: n, **{n + i: 1 for i in range(5)}}


def test_edges_must_end_at_listed_players(spark):
    nodes, edges = lanes_of(spark, [(1, 2, 1)])
    with pytest.raises(Exception, match="does not list"):
        G.network_scores(nodes.where("player_id = 1"), edges, KEYS).collect()


def test_reciprocal_edges_keep_the_higher_source(spark):
    key = "game_id long, team_id long, season string, provider string"
    edges = spark.createDataFrame([(1, 1, "s", "p", 1, 2, 9), (1, 1, "s", "p", 2, 1, 4)], f"{key}, source long, target long, weight long")
    assert G.undirected_edges(edges, KEYS).first()["weight"] == 4.0


def test_zero_weight_edge_is_a_long_way(spark):
    df = spark.createDataFrame([(1, 2, 0.0), (2, 3, 4.0)], "source long, target long, xt_weight double")
    got = {r["source"]: r["distance"] for r in G.edge_distance(df, "xt_weight").collect()}
    assert got == {1: 1e12, 2: 0.25}
    with pytest.raises(KeyError):
        G.edge_distance(df, "nothing")


def test_structure_small_networks(spark):
    key = "game_id long, team_id long, season string, provider string"
    nodes = spark.createDataFrame([(1, 1, "s", "p", 1), (2, 1, "s", "p", 1), (2, 1, "s", "p", 2)], f"{key}, player_id long")
    edges = spark.createDataFrame([(2, 1, "s", "p", 1, 2, 3)], f"{key}, source long, target long, weight long")
    got = {r["game_id"]: r for r in G.structure(nodes, edges).collect()}
    assert got[1]["team_density"] is None and got[1]["team_centralization"] is None
    assert got[2]["team_density"] == 0.5 and got[2]["team_centralization"] is None


# --- leaderboards ------------------------------------------------------------------------


def test_role_relative(spark):
    rows = []
    for role, scale in (("GK", 0.01), ("DEF", 0.05), ("MID", 0.2), ("FWD", 0.08)):
        rows += [(role, scale * i, 3.0) for i in (1, 2, 3)]
    rows.append((None, 1.0, 3.0))
    df = spark.createDataFrame(rows, "coarse_role string, pagerank double, closeness double")
    out = L.role_relative(df, metrics=("pagerank", "closeness"))
    per = out.groupBy("coarse_role").agg(F.avg("pagerank_z").alias("m")).collect()
    assert all(abs(r["m"]) < 1e-9 for r in per)
    assert out.where("closeness_z <> 0").isEmpty()
    with pytest.raises(KeyError):
        L.role_relative(df, role_column="role")


def test_player_season_needs_its_metrics(spark):
    df = spark.createDataFrame([("s", "p", 1, 0.5)], "season string, provider string, player_id long, pagerank double")
    with pytest.raises(KeyError):
        L.player_season(df)
    assert L.player_season(df, 1, ("pagerank",)).count() == 1
    assert L.player_season(df, 2, ("pagerank",)).count() == 0


def residual_table(spark, metric):
    xs = np.linspace(5, 100, 12)
    ys = [15.0, 34.0, 53.0] * 4
    rows = [("s", "p", i, float(x), float(y), float(metric(x, y))) for i, (x, y) in enumerate(zip(xs, ys))]
    return spark.createDataFrame(rows, "season string, provider string, player_id long, mean_x double, mean_y double, m double")


def test_quadratic_metric_is_explained(spark):
    df = residual_table(spark, lambda x, y: 2 + 0.3 * x - 0.002 * x * x + 0.01 * y + 0.001 * x * y)
    frame, r2 = L.position_residual(df, metrics=("m",))
    assert r2.first()["r2"] == pytest.approx(1.0, abs=1e-6)
    assert frame.where(F.abs("m_r") > 1e-6).isEmpty()


def test_residual_equals_least_squares(spark):
    rng = random.Random(4)
    df = residual_table(spark, lambda x, y: math.sin(x / 9) + rng.random())
    frame, r2 = L.position_residual(df, metrics=("m",))
    rows = frame.orderBy("player_id").collect()
    x = np.array([r["mean_x"] for r in rows])
    y = np.array([r["mean_y"] for r in rows])
    v = np.array([r["m"] for r in rows])
    design = np.column_stack([np.ones(12), x, y, x * x, y * y, x * y])
    left = v - design @ np.linalg.lstsq(design, v, rcond=None)[0]
    assert np.allclose([r["m_r"] for r in rows], left, atol=1e-6)
    assert r2.first()["r2"] == pytest.approx(1 - (left**2).sum() / ((v - v.mean()) ** 2).sum(), abs=1e-6)


def test_flat_and_small_groups_have_no_fit(spark):
    flat = residual_table(spark, lambda x, y: 0.1)
    frame, r2 = L.position_residual(flat, metrics=("m",))
    assert r2.first()["r2"] == 0.0 and frame.where("m_r <> 0").isEmpty()
    small = residual_table(spark, lambda x, y: x).limit(5)
    frame, r2 = L.position_residual(small, metrics=("m",))
    assert r2.first()["r2"] == 0.0 and frame.where("m_r <> 0").isEmpty()
    with pytest.raises(KeyError):
        L.position_residual(flat.drop("mean_x"), metrics=("m",))


def test_spearman_with_ties(spark):
    rows = [("s", "p", i, float(a), float(b)) for i, (a, b) in enumerate([(1, 1), (2, 2), (2, 3), (3, 2)])]
    df = spark.createDataFrame(rows, "season string, provider string, player_id long, a double, b double")
    ranks_a, ranks_b = [1, 2.5, 2.5, 4], [1, 2.5, 4, 2.5]
    wanted = np.corrcoef(ranks_a, ranks_b)[0, 1]
    assert L.mean_pairwise_spearman(df, ("a", "b")).first()["mean_spearman"] == pytest.approx(wanted)


# --- node features -----------------------------------------------------------------------


def test_direction_features(spark):
    key = "game_id long, team_id long, season string, provider string"
    nodes = spark.createDataFrame(
        [(1, 1, "s", "p", p, x, 10, 10, 8) for p, x in ((1, 5.0), (2, 50.0), (3, 90.0))],
        f"{key}, player_id long, mean_x double, touches long, passes_attempted long, passes_completed long",
    )
    edges = spark.createDataFrame(
        [(1, 1, "s", "p", 1, 2, 10, 40.0, 35.0), (1, 1, "s", "p", 2, 3, 10, 20.0, 15.0), (1, 1, "s", "p", 3, 2, 10, 10.0, -12.0)],
        f"{key}, source long, target long, weight long, mean_length double, mean_dx double",
    )
    got = {r["player_id"]: r for r in FE.node_features(nodes, edges).collect()}
    assert got[1]["progression_made"] == 35 and got[3]["progression_made"] == -12
    assert got[3]["progression_received"] == 15 and got[1]["progression_received"] == 0
    assert got[1]["degree_out_norm"] == got[3]["degree_out_norm"]
    empty = FE.node_features(nodes, edges.limit(0)).first()
    assert all(empty[c] == 0 for c in S.DIRECTION_FEATURES)
    with pytest.raises(FE.FeatureError):
        FE.node_features(nodes, edges, S.WINDOW_KEYS)
    with pytest.raises(FE.FeatureError):
        hole = nodes.withColumn("window_index", F.lit(None).cast("long"))
        FE.node_features(hole, edges.withColumn("window_index", F.lit(0)), S.WINDOW_KEYS)


def test_window_features_do_not_see_the_future(spark):
    rows = Q.infer_recipients(frames.actions(spark, frames.random_rows(11, n=120, games=1)))
    names = [*S.DIRECTION_FEATURES, "strength_in_norm", "edge_share_out"]

    def upto(window):
        early = rows.where((F.col("time_seconds") / 60 + F.when(F.col("period_id") == 2, 45).otherwise(0)) < 15 + 5 * window)
        frame = FE.window_features(*N.windowed_networks(early))
        return sorted(
            tuple(round(r[c], 9) for c in ("team_id", "player_id", *names))
            for r in frame.where(F.col("window_index") == window).collect()
        )

    full = FE.window_features(*N.windowed_networks(rows))
    for window in (0, 12):
        whole = sorted(
            tuple(round(r[c], 9) for c in ("team_id", "player_id", *names))
            for r in full.where(F.col("window_index") == window).collect()
        )
        assert whole and whole == upto(window)
