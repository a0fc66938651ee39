import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import frames
from pitchloom import schema as S
from pitchloom.functions.text import normalise_name, surname, unescape_name
from pitchloom.operators import chains as C, harmonise as H, identity as I, models as M, scores as K, similarity as V
from pitchloom.sources import provider_files as P, store as A


def test_scores_against_definitions(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        p = [rng.random() for _ in range(3)]
        rows.append((i // 6, rng.randint(0, 2), [v / sum(p) for v in p]))
    rows.append((99, 1, [1.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "game_id long, y int, probabilities array<double>")
    got = K.score(df).first()
    p = np.clip(np.array([r[2] for r in rows]), 1e-15, 1)
    p /= p.sum(axis=1, keepdims=True)
    y = np.array([r[1] for r in rows])
    assert got["log_loss"] == pytest.approx(-np.log(p[np.arange(len(y)), y]).mean())
    assert got["brier"] == pytest.approx(((p - np.eye(3)[y]) ** 2).sum(axis=1).mean())
    assert got["accuracy"] == pytest.approx((p.argmax(axis=1) == y).mean())
    conf, ok, ece = p.max(axis=1), p.argmax(axis=1) == y, 0.0
    edges = np.linspace(0, 1, 11)
    for lo, hi in zip(edges, edges[1:]):
        mask = (conf > lo) & (conf <= hi)
        if mask.any():
            ece += mask.mean() * abs(ok[mask].mean() - conf[mask].mean())
    assert got["ece"] == pytest.approx(ece)
    boot = K.bootstrap_by_match(df.withColumn("model", F.lit("m")), ["model"], 100).first()
    assert boot["ci_low"] <= boot["point"] <= boot["ci_high"] and boot["n_matches"] == 11
    again = K.bootstrap_by_match(df.repartition(7).withColumn("model", F.lit("m")), ["model"], 100).first()
    assert again["ci_low"] == pytest.approx(boot["ci_low"])


def test_wilson_and_lift(spark):
    df = spark.createDataFrame([(0, 20), (20, 20), (5, 20), (50, 200), (0, 0)], "k long, n long")
    low, high = K.wilson("k", "n")
    rows = df.select("k", "n", low.alias("lo"), high.alias("hi")).collect()
    for r in rows[:4]:
        assert 0 <= r["lo"] <= r["k"] / r["n"] + 1e-9 and r["k"] / r["n"] - 1e-9 <= r["hi"] <= 1
    assert rows[3]["hi"] - rows[3]["lo"] < rows[2]["hi"] - rows[2]["lo"] and rows[4]["lo"] is None
    chains = spark.createDataFrame([(0, True, "test"), (0, False, "test"), (1, False, "test"), (1, True, "train")], "cluster long, ends_in_shot boolean, fold string")
    got = {r["cluster"]: r for r in K.shot_lift(chains.where("fold = 'test'")).collect()}
    assert got[0]["base_rate"] == pytest.approx(1 / 3) and got[0]["lift"] == pytest.approx(1.5)


def test_percent_rank(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 3)], "v int")
    assert sorted(r[0] for r in df.select(C.percent_rank_mean("v")).collect()) == [0.25, 0.625, 0.625, 1.0]


def test_cosine_means_equal_pair_loops(spark):
    rng = np.random.default_rng(0)
    rows = [(i % 4, [float(x) for x in rng.normal(size=5)]) for i in range(23)]
    df = spark.createDataFrame(rows, "player_id long, v array<double>")
    got = V.within_entity_consistency(df, "player_id", "v").first()
    x = np.array([r[1] for r in rows])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids, cos = np.array([r[0] for r in rows]), u @ u.T
    same = np.mean([cos[np.ix_(ids == p, ids == p)][np.triu_indices((ids == p).sum(), 1)].mean() for p in range(4)])
    diff = np.mean([cos[np.ix_(ids == p, ids != p)].mean() for p in range(4)])
    assert got["same_player_cosine"] == pytest.approx(same) and got["diff_player_cosine"] == pytest.approx(diff)


def test_half_season(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(8, 6))
    rows = [(p, 10 if i < 6 else 30, [float(v) for v in base[p] + 0.05 * rng.normal(size=6)]) for p in range(8) for i in range(12)]
    rows.append((99, 10, [0.0] * 6))
    df = spark.createDataFrame(rows, "player_id long, week int, v array<double>")
    got = V.half_season_stability(df, "v").first()
    assert got["n_players"] == 8 and got["lift"] > 0.7
    noise = [(p, w, [float(v) for v in rng.normal(size=6)]) for p, w, _ in rows[:-1]]
    assert abs(V.half_season_stability(spark.createDataFrame(noise, df.schema), "v").first()["lift"]) < 0.6


def test_ks_with_one_heavy_value(spark):
    rng = random.Random(5)
    left = [5.0] * 400 + [rng.uniform(0, 10) for _ in range(300)]
    right = [rng.uniform(2, 12) for _ in range(500)]
    rows = [(True, "f", v) for v in left] + [(False, "f", v) for v in right]
    df = spark.createDataFrame(rows, "is_left boolean, feature string, value double")
    points = sorted(set(left + right))
    wanted = max(abs(np.mean(np.array(left) <= v) - np.mean(np.array(right) <= v)) for v in points)
    assert H.ks_statistic(df, block=50).first()["ks_statistic"] == pytest.approx(wanted)


def test_names(spark):
    df = spark.createDataFrame([("Gonzalo Higuaín",), ("M. Pjanić",), ("",), (None,)], "n string")
    full = df.select(normalise_name(F.col("n")).alias("f"))
    assert [r["f"] for r in full.collect()] == ["gonzalo higuain", "m pjanic", "", ""]
    assert [r[0] for r in full.select(surname(F.col("f"))).collect()] == ["higuain", "pjanic", "", ""]
    raw = spark.createDataFrame([("Pjani\\u0107",), ('a "q" \\n é \\u00e9',), ("plain é",)], "n string")
    assert [r[0] for r in raw.select(unescape_name(F.col("n"))).collect()] == ["Pjanić", 'a "q" \\n é é', "plain é"]


def test_match_players(spark):
    left = spark.createDataFrame([(1, "Gonzalo Higuaín"), (2, "Miralem Pjanić"), (3, "Ann Lee"), (4, "Bob Lee"), (5, "")], "player_id long, player_name string")
    right = spark.createDataFrame([(11, "gonzalo higuain"), (12, "M. Pjanic"), (13, "C. Lee"), (14, "...")], "player_id long, player_name string")
    got = sorted((r[0], r[1], r[2]) for r in I.match_players(left, right).where("player_id_left <> 5").collect())
    assert got == [(1, 11, "full_name"), (2, 12, "surname")]


def test_roles(spark):
    df = spark.createDataFrame([("Goalkeeper",), ("Left Wing",), (None,), ("Sweeper",)], "position string")
    with pytest.raises(I.UnknownPosition):
        I.coarse_role(df, "position", "fine")
    got = {r["position"]: r["coarse_role"] for r in I.coarse_role(df, "position", "fine", strict=False).collect()}
    assert got == {"Goalkeeper": "GK", "Left Wing": "FWD", None: None, "Sweeper": None}
    assert len(S.FINE_POSITION_ROLES) == 25


def test_provider_files(spark, tmp_path):
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "77.json").write_text(json.dumps([
        {"id": "a", "possession": 3, "pass": {"recipient": {"id": 5, "name": "x"}}, "position": {"id": 1, "name": "Goalkeeper"}},
        {"id": "b", "shot": {"statsbomb_xg": 0.4}, "under_pressure": True},
    ]))
    (tmp_path / "events" / "78.json").write_text('[{"id": "c", "poss')
    good, bad = P.quarantine(P.read_documents(spark, str(tmp_path / "events"), P.EVENT_DDL).cache())
    rows = {r["original_event_id"]: r for r in P.event_truth(good).collect()}
    assert rows["a"]["true_recipient_id"] == 5 and rows["a"]["game_id"] == 77 and not rows["a"]["under_pressure"]
    assert rows["b"]["statsbomb_xg"] == 0.4 and rows["b"]["true_recipient_id"] is None
    assert [r["game_id"] for r in bad.collect()] == [78]


def test_lineup_spells(spark, tmp_path):
    spells = [
        {"position": "Left Back", "from": "00:00", "to": "45:00", "start_reason": "Starting XI"},
        {"position": "Left Wing", "from": "45:00", "to": None, "start_reason": "Shift"},
    ]
    team = [{"team_id": 1, "team_name": "T", "lineup": [
        {"player_id": 5, "player_name": "Long", "player_nickname": "Nick", "positions": spells},
        {"player_id": 6, "player_name": "Bench", "player_nickname": None, "positions": []},
        {"player_id": 7, "player_name": "Late", "player_nickname": None, "positions": [{"position": "Left Wing", "from": "01:10:30", "to": "60:00", "start_reason": "Sub"}]},
    ]}]
    (tmp_path / "9.json").write_text(json.dumps(team))
    rows = {r["player_id"]: r for r in P.lineup_spells(P.read_documents(spark, str(tmp_path), P.LINEUP_DDL)).collect()}
    assert rows[5]["position_name_24"] == "Left Back" and rows[5]["minutes_played"] == 90 and rows[5]["started"]
    assert rows[5]["player_name"] == "Nick" and rows[6]["position_name_24"] is None and rows[6]["minutes_played"] == 0
    assert rows[7]["minutes_played"] == 0 and not rows[7]["started"] and rows[7]["game_id"] == 9


def test_backfill_refuses_swapped_sides(spark):
    games = spark.createDataFrame([(1, "w", 10, 20, None, None), (2, "v", 10, 20, 1, 1)], "game_id long, provider string, home_team_id long, away_team_id long, home_score int, away_score int")
    fill = "game_id long, home_score_fill int, away_score_fill int, home_team_check long, away_team_check long"
    got = P.backfill_scores(games, spark.createDataFrame([(1, 3, 0, 10, 20)], fill), "w").orderBy("game_id").collect()
    assert (got[0]["home_score"], got[0]["away_score"], got[1]["home_score"]) == (3, 0, 1)
    with pytest.raises(P.OrientationError):
        P.backfill_scores(games, spark.createDataFrame([(1, 3, 0, 20, 10)], fill), "w")


def test_store_round_trip(spark, tmp_path, sf):
    from pitchloom.plans.stream_plans import chained

    root = str(tmp_path / "store")
    rows = chained(spark, sf)
    A.write_actions(rows, root)
    assert A.scan_actions(spark, root).count() == rows.count()
    assert A.store_inventory(spark, root).where("size_mb <= 0").isEmpty()
    plan = A.scan_actions(spark, root, season="2000").select("action_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "start_x" not in plan
    with pytest.raises(A.StoreError):
        A.scan_actions(spark, root, season="1900")
    with pytest.raises(A.StoreError):
        A.validate_canonical(rows.withColumn("start_x", F.lit(200.0)))
    with pytest.raises(A.StoreError):
        A.validate_canonical(rows.drop("type_id"))
    games = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "game_id long, provider string, v int")
    A.upsert_games(spark, str(tmp_path / "games"), games)
    A.upsert_games(spark, str(tmp_path / "games"), spark.createDataFrame([(3, "b", 9)], games.schema))
    assert sorted(r["game_id"] for r in A.read_games_index(spark, str(tmp_path / "games")).collect()) == [1, 3]


def test_a_failed_index_write_leaves_the_old_or_the_new(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "games")
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "game_id long, provider string, v int")
    two = spark.createDataFrame([(3, "b", 2)], one.schema)
    read = lambda: sorted(r["game_id"] for r in A.read_games_index(spark, path).collect())
    A.upsert_games(spark, path, one)

    def refuse(*_):
        raise A.StoreError("refused")

    # While the new version is written, and when its pointer is put down: the old one stays.
    with monkeypatch.context() as m:
        m.setattr(A, "upsert_by_provider", refuse)
        with pytest.raises(A.StoreError):
            A.upsert_games(spark, path, two)
    assert read() == [1, 2]
    with monkeypatch.context() as m:
        m.setattr(A, "_move", refuse)
        with pytest.raises(A.StoreError):
            A.upsert_games(spark, path, two)
    assert read() == [1, 2]
    A.upsert_games(spark, path, two)
    assert read() == [1, 3]
    # While old versions are removed: the new one is in place.
    with monkeypatch.context() as m:
        m.setattr(A, "_remove", refuse)
        with pytest.raises(A.StoreError):
            A.upsert_games(spark, path, spark.createDataFrame([(9, "a", 2)], one.schema))
    assert read() == [3, 9]
    for i in range(3):
        A.upsert_games(spark, path, two)
    assert read() == [3, 9]


def test_unsound_rows_do_not_reach_the_store(spark, tmp_path, sf):
    from pitchloom.plans.stream_plans import chained

    root, rows = str(tmp_path / "store"), chained(spark, sf)
    A.write_actions(rows, root)
    before = A.scan_actions(spark, root).count()
    with pytest.raises(A.StoreError, match="start_x"):
        A.write_actions(rows.withColumn("start_x", F.lit(300.0)), root)
    assert A.scan_actions(spark, root).count() == before
    # A rewrite of one match's season replaces that season's partition only.
    season = rows.select("season").first()["season"]
    part = rows.where(F.col("season") == season).limit(10)
    A.write_actions(part, root)
    assert A.scan_actions(spark, root, season=season).count() == 10
    assert A.scan_actions(spark, root).count() == before - rows.where(F.col("season") == season).count() + 10
    with pytest.raises(A.StoreError, match="start_x"):
        A.write_streams(rows.withColumn("start_x", F.lit(300.0)), str(tmp_path / "bad"), 2)


def test_streams_are_read_where_they_lie(spark, tmp_path, sf):
    from pitchloom.operators import chains as C, network as N, sequence as Q
    from pitchloom.sources.event_actions import read_actions

    root = str(tmp_path / "streams")
    A.write_streams(read_actions(spark, sf), root, buckets=3)
    rows = A.scan_streams(spark, root)
    assert rows.count() == read_actions(spark, sf).count()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for table in (Q.infer_recipients(rows), Q.annotate_actions(rows), *N.windowed_networks(Q.infer_recipients(rows)),
                  C.chain_table(Q.annotate_actions(rows))):
        assert "Exchange" not in plan(table)


def test_weights_and_alignment(spark):
    loss = spark.createDataFrame([(i, 1.0 - 0.03 * i) for i in range(16)], "window_index long, log_loss double")
    for scheme in ("uniform", "linear", "b0_signal"):
        table = M.checkpoint_weights(spark, scheme, loss)
        assert table.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        M.checkpoint_weights(spark, "b0_signal", loss.limit(3))
    df = spark.createDataFrame([([0.3, 0.7],)], "p array<double>")
    assert df.select(M.align_classes("p", [0, 2])).first()[0] == [0.3, 0.0, 0.7]


def test_logistic_learns_on_train_only(spark):
    rows = [(i, i % 3, float(i % 3) + 0.01 * (i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "game_id long, outcome_index long, x double")
    predict = M.fit_logistic(df, ["x"], strength=100.0)
    scored = predict(df).select("game_id", F.col("outcome_index").alias("y"), "probabilities")
    assert K.score(scored).first()["accuracy"] > 0.95


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
