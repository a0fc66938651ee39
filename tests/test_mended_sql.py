"""Queries that differed from their SQL, each with a small case."""

import duckdb
import math

from pitchloom.operators import graph as G
from pitchloom.plans import season_plans as P
from pitchloom.plans.sqlkit import CTES


def test_betweenness_counts_paths_as_seen_from_their_source(spark):
    """Behind a worthless lane two ways tie that do not tie for the player in the middle."""
    lanes = [(1, 2, 0.0), (2, 3, 1 / 20.0), (2, 4, 1 / 20.004), (3, 5, 0.1), (4, 5, 0.1)]
    rows = [(7, 1, "s", "p", a, b, 1, w) for a, b, w in lanes]
    ddl = "game_id long, team_id long, season string, provider string, source long, target long, weight long, xt_weight double"
    edges = spark.createDataFrame(rows, ddl)
    nodes = spark.createDataFrame([(7, 1, "s", "p", i) for i in range(1, 6)],
                                  "game_id long, team_id long, season string, provider string, player_id long")
    found = {r["player_id"]: r["betweenness"] for r in G.network_scores(
        nodes, edges, weight_column="xt_weight", measures=("betweenness",)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE xt_edges (game_id BIGINT, team_id BIGINT, season VARCHAR, provider VARCHAR, "
                "source BIGINT, target BIGINT, weight BIGINT, xt_weight DOUBLE)")
    con.executemany("INSERT INTO xt_edges VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    names = "xt_links xt_legs xt_least xt_tight xt_steps xt_counts xt_flows xt_shares".split()
    body = ", ".join(f"{name} AS ({CTES[name][1]})" for name in names)
    credit = dict(con.execute(f"WITH RECURSIVE {body} SELECT player_id, credit FROM xt_shares").fetchall())
    assert credit == {2: 3.0, 3: 1.5, 4: 0.5}
    assert found == {i: credit.get(i, 0.0) / 12 for i in range(1, 6)}


def test_half_way_values_round_up_in_spite_of_noise(spark):
    exact = 243 / 640
    values = [exact, math.nextafter(exact, 0), math.nextafter(exact, 1), 1 / 640, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    mine = [r["x"] for r in P.settled_report(df).collect()]
    sql = duckdb.connect().execute(
        f"SELECT {P._settled_sql('x')} FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()
    assert mine == [r[0] for r in sql] == [0.379688, 0.379688, 0.379688, 0.001563, None]
