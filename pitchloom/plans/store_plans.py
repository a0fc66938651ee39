"""Queries on the store, raw provider text, samples, composite reports and fitted models."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.functions.hashing import mix_sql
from pitchloom.operators import (
    chains as C, features as FE, models as M, network as N, review as R, scores as K,
    sequence as Q, similarity as V, splits as SP, state as ST,
)
from pitchloom.plans.book import Book
from pitchloom.plans.graph_plans import directory, teams_of
from pitchloom.plans.score_plans import folded_chains, predictions, vectors
from pitchloom.plans.sqlkit import CTES, NK, quoted, r, with_sql
from pitchloom.plans.stream_plans import chained, passes
from pitchloom.plans.threat_plans import labelled_chains, rated, split, states
from pitchloom.runtime import attach_row, checkpoint_dir, durable, staged
from pitchloom.sources import provider_files as P, store as A
from pitchloom.sources.event_actions import (
    read_actions, read_games, read_lineup, read_table, read_truth, season_columns,
)

BOOK = Book()
q = BOOK.add


def _store(spark, sf):
    """The annotated actions written to a fresh store in the shared folder."""
    import uuid

    root = f"{checkpoint_dir(spark)}/actions-{uuid.uuid4().hex}"
    A.write_actions(A.by_partition(chained(spark, sf)), root)
    return root


@q("scan_actions_a1", with_sql("chained", """
SELECT game_id, count(*) AS n, count(recipient_id) AS resolved FROM chained WHERE season = '2001' AND provider = 'beta' GROUP BY 1"""))
def scan_actions(spark, sf):
    rows = A.scan_actions(spark, _store(spark, sf), "2001", "beta")
    return rows.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.count("recipient_id").alias("resolved"))


@q("write_actions_a2", with_sql("chained", """
SELECT action_id, game_id, possession_id, season, provider FROM chained"""))
def write_actions(spark, sf):
    return A.scan_actions(spark, _store(spark, sf)).select(
        "action_id", "game_id", "possession_id", "season", "provider"
    )


@q("upsert_games_a3", with_sql("games", """
SELECT game_id, provider, home_score FROM games WHERE provider = 'alpha'
UNION ALL SELECT game_id, provider, 9 FROM games WHERE provider = 'beta'"""))
def upsert_games(spark, sf):
    """An index is written, one provider's matches are rebuilt, and the new version is read."""
    import uuid

    path = f"{checkpoint_dir(spark)}/games-{uuid.uuid4().hex}"
    games = read_games(spark, sf)
    A.upsert_games(spark, path, games)
    A.upsert_games(spark, path, games.where(F.col("provider") == "beta").withColumn("home_score", F.lit(9)))
    return A.read_games_index(spark, path).select("game_id", "provider", "home_score")


@q("stream_store_a2", with_sql("chained", """
SELECT action_id, game_id, recipient_id, possession_id, possession_team_id FROM chained"""))
def stream_store(spark, sf):
    """Recipients and possessions of actions read from a store that is dealt by match."""
    import uuid

    root = f"{checkpoint_dir(spark)}/streams-{uuid.uuid4().hex}"
    A.write_streams(read_actions(spark, sf), root)
    return Q.annotate_actions(A.scan_streams(spark, root)).select(
        "action_id", "game_id", "recipient_id", "possession_id", "possession_team_id")


@q("store_inventory_a4", with_sql("actions", f"""
SELECT season, provider, count(DISTINCT game_id) AS games, count(*) AS actions,
  {r('count(*) / count(DISTINCT game_id)', 'actions_per_game')}, TRUE AS on_disk FROM actions GROUP BY 1, 2"""))
def store_inventory(spark, sf):
    table = A.store_inventory(spark, _store(spark, sf))
    return X.round_report(table.withColumn("on_disk", F.col("size_mb") > 0).drop("size_mb"))


def raw_events(spark, sf):
    """Provider-style event JSON text built from the event rows."""
    rows = read_truth(spark, sf).join(
        read_actions(spark, sf).select("original_event_id", "game_id", "action_id", "type_name", "start_x"),
        "original_event_id",
    )
    named = F.struct(F.col("true_recipient_id").alias("id"))
    body = F.struct(
        F.col("original_event_id").alias("id"), F.col("statsbomb_possession").alias("possession"),
        F.when(F.col("true_recipient_id").isNotNull(), F.struct(named.alias("recipient"))).alias("pass"),
        F.when(X.is_shot(), F.struct((F.col("start_x") / 105.0).alias("statsbomb_xg"))).alias("shot"),
        F.when(F.col("action_id") % 5 == 0, F.lit(True)).alias("under_pressure"),
        F.struct(F.col("type_name").alias("name")).alias("play_pattern"),
        F.struct((F.col("action_id") % 25).alias("id"), F.lit("Center Back").alias("name")).alias("position"),
    )
    return rows.select("game_id", F.to_json(body).alias("doc"))


@q("event_truth_a5", with_sql(["actions", "truth"], f"""
SELECT a.game_id, original_event_id, true_recipient_id, statsbomb_possession,
  {r("CASE WHEN starts_with(type_name, 'shot') THEN start_x / 105e0 END", 'statsbomb_xg')}, action_id % 5 = 0 AS under_pressure,
  type_name AS play_pattern, 'Center Back' AS position_name_24, action_id % 25 AS position_id_24
FROM actions a JOIN truth USING (original_event_id)"""))
def event_truth(spark, sf):
    good, _ = P.quarantine(P.parse_documents(raw_events(spark, sf), "doc", P.EVENT_DDL))
    return X.round_report(P.event_truth(good))


def raw_lineups(spark, sf):
    """Lineup JSON per match and team: one player list with up to two spells each."""
    seen = (
        read_actions(spark, sf).where(F.col("player_id").isNotNull())
        .select("game_id", "team_id", "player_id").distinct()
    )
    first_half = F.format_string("%02d:30", (F.col("player_id") % 40 + 20).cast("int"))
    spell = [
        F.struct(F.lit("Center Back").alias("position"), F.lit("00:00").alias("from"), first_half.alias("to"),
                 F.lit("Starting XI").alias("start_reason")),
        F.struct(F.lit("Right Back").alias("position"), first_half.alias("from"), F.lit(None).cast("string").alias("to"),
                 F.lit("Tactical Shift").alias("start_reason")),
    ]
    player = F.struct(
        "player_id", F.concat(F.lit("Player "), F.col("player_id").cast("string")).alias("player_name"),
        F.when(F.col("player_id") % 2 == 0, F.concat(F.lit("P"), F.col("player_id").cast("string"))).alias("player_nickname"),
        F.when(F.col("player_id") % 7 != 0, F.array(*spell)).otherwise(F.array(spell[1])).alias("positions"),
    )
    # A match squad is a few dozen players; the list is per (match, team).
    squads = seen.groupBy("game_id", "team_id").agg(F.sort_array(F.collect_list(player)).alias("lineup"))
    body = F.struct("team_id", F.concat(F.lit("team "), F.col("team_id").cast("string")).alias("team_name"), "lineup")
    return squads.select("game_id", F.to_json(body).alias("doc"))


@q("lineup_spells_a6", with_sql("actions", f"""
SELECT game_id, team_id, player_id, 'team ' || team_id AS team_name,
  CASE WHEN player_id % 2 = 0 THEN 'P' || player_id ELSE 'Player ' || player_id END AS player_name,
  CASE WHEN player_id % 7 <> 0 AND cut >= 90 - cut THEN 'Center Back' ELSE 'Right Back' END AS position_name_24,
  {r('CASE WHEN player_id % 7 <> 0 THEN 90 ELSE 90 - cut END', 'minutes_played')}, player_id % 7 <> 0 AS started
FROM (SELECT DISTINCT game_id, team_id, player_id, player_id % 40 + 20.5e0 AS cut FROM actions WHERE player_id IS NOT NULL)"""))
def lineup_spells(spark, sf):
    parsed = P.parse_documents(raw_lineups(spark, sf), "doc", P.LINEUP_DDL)
    return X.round_report(P.lineup_spells(P.quarantine(parsed)[0]))


@q("validate_canonical_a7", with_sql("actions", """
SELECT count(*) AS rows, count(*) FILTER (period_id IS NULL) AS null_period, count(*) FILTER (time_seconds < 0) AS negative_time,
  count(*) FILTER (sx > 107 OR sx < -2) AS start_x_out_of_pitch, count(*) FILTER (end_x > 107 OR end_x < -2) AS end_x_out_of_pitch,
  count(*) FILTER (start_y > 70 OR start_y < -2) AS start_y_out_of_pitch, count(*) FILTER (end_y > 70 OR end_y < -2) AS end_y_out_of_pitch
FROM (SELECT *, start_x * 1.1e0 AS sx FROM actions)"""))
def validate_canonical(spark, sf):
    return A.canonical_faults(read_actions(spark, sf).withColumn("start_x", F.col("start_x") * F.lit(1.1)))


@q("leakage_guard_a8", with_sql(["features"], "SELECT count(*) AS n, 'clean' AS verdict FROM features"))
def leakage_guard(spark, sf):
    frame = FE.node_features(*N.match_networks(passes(spark, sf)), check=False)
    SP.assert_no_enrichment(frame, "node features")
    return frame.agg(F.count(F.lit(1)).alias("n"), F.lit("clean").alias("verdict"))


@q("canonicalise_a9", with_sql(["actions", "games"], f"""
SELECT action_id, type_name, result_name, a.season, {r('CASE WHEN team_id <> home_team_id THEN 105 - start_x ELSE start_x END', 'start_x')},
  {r('CASE WHEN team_id <> home_team_id THEN 105 - end_x ELSE end_x END', 'end_x')},
  {r('CASE WHEN team_id <> home_team_id THEN 68 - start_y ELSE start_y END', 'start_y')},
  {r('CASE WHEN team_id <> home_team_id THEN 68 - end_y ELSE end_y END', 'end_y')}
FROM actions a JOIN games g USING (game_id)"""))
def canonicalise(spark, sf):
    raw = read_actions(spark, sf).drop("type_name", "result_name", "season", "provider")
    table = A.canonicalise(raw, read_games(spark, sf))
    return X.round_report(
        table.select("action_id", "type_name", "result_name", "season", "start_x", "end_x", "start_y", "end_y")
    )


@q("season_action_key_a10", with_sql("actions", """
SELECT action_id, row_number() OVER (PARTITION BY game_id ORDER BY period_id, time_seconds, action_id) - 1 + game_id * 100000 AS season_action_id
FROM actions"""))
def season_action_key(spark, sf):
    return A.season_action_key(read_actions(spark, sf)).select("action_id", "season_action_id")


@q("backfill_scores_a11", with_sql("games", """
SELECT game_id, provider, CASE WHEN provider = 'beta' THEN CAST(game_id % 5 AS INTEGER) ELSE home_score END AS home_score,
  CASE WHEN provider = 'beta' THEN CAST(game_id % 3 AS INTEGER) ELSE away_score END AS away_score FROM games"""))
def backfill_scores(spark, sf):
    games = read_games(spark, sf)

    def team(side, score):
        return F.struct(
            F.lit(side).alias("side"), score.cast("int").alias("score"), F.col(f"{side}_team_id").alias("teamId")
        )

    body = F.struct(
        F.col("game_id").alias("wyId"),
        F.create_map(
            F.col("home_team_id").cast("string"), team("home", F.col("game_id") % 5),
            F.col("away_team_id").cast("string"), team("away", F.col("game_id") % 3),
        ).alias("teamsData"),
    )
    parsed = P.parse_documents(games.select(F.to_json(body).alias("doc")), "doc", P.MATCH_DDL)
    filled = P.backfill_scores(games, P.match_scores(P.quarantine(parsed)[0]), "beta")
    return filled.select("game_id", "provider", "home_score", "away_score")


@q("quarantine_a12", with_sql("actions", """
SELECT game_id, CASE WHEN action_id % 10 = 0 THEN 'bad' ELSE 'good' END AS verdict, count(*) AS n
FROM actions JOIN (SELECT 1) ON TRUE GROUP BY 1, 2"""))
def quarantine(spark, sf):
    rows = raw_events(spark, sf)
    number = F.regexp_extract("doc", '"id":"e([0-9]+)"', 1).cast("long")
    cut = rows.withColumn(
        "doc", F.when(number % 10 == 0, F.expr("left(doc, length(doc) - 3)")).otherwise(F.col("doc"))
    )
    good, bad = P.quarantine(P.parse_documents(cut, "doc", P.EVENT_DDL))
    both = good.select("game_id", F.lit("good").alias("verdict")).unionByName(
        bad.select("game_id", F.lit("bad").alias("verdict"))
    )
    return both.groupBy("game_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@q("only_available_a13", with_sql(["games", "actions"], """
SELECT game_id FROM games SEMI JOIN (SELECT game_id FROM actions WHERE type_name = 'shot_penalty') USING (game_id)"""))
def only_available(spark, sf):
    landed = read_actions(spark, sf).where(F.col("type_name") == "shot_penalty")
    return A.only_available(read_games(spark, sf), landed).select("game_id")


@q("stratified_sample_a14", f"""
SELECT DISTINCT o_orderkey, o_orderstatus, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {mix_sql('o_orderkey', seed=4)}, o_orderkey) AS a,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY {mix_sql('o_orderkey', seed=4)}, o_orderkey) AS b FROM orders)
WHERE a <= 100 OR b <= 100""")
def stratified_sample(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return A.stratified_sample(orders, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"], 100, seed=4)


@q("prefix_sample_a15", with_sql("wnodes", f"""
SELECT {NK}, window_index, player_id FROM wnodes SEMI JOIN (
  SELECT game_id FROM (SELECT game_id, row_number() OVER (PARTITION BY season ORDER BY game_id) AS n
    FROM (SELECT DISTINCT season, game_id FROM wnodes)) WHERE n <= 3) USING (game_id)"""))
def prefix_sample(spark, sf):
    nodes = N.windowed_networks(passes(spark, sf))[0]
    return A.prefix_sample(nodes, 3).select(*S.NETWORK_KEYS, "window_index", "player_id")


@q("manifest_a16", with_sql(["games", "nodes", "edges"], """
SELECT 'games' AS table_name, count(*) AS n_rows, 9 AS n_columns FROM games
UNION ALL SELECT 'nodes', count(*), 13 FROM nodes UNION ALL SELECT 'edges', count(*), 9 FROM edges"""))
def manifest(spark, sf):
    nodes, edges = N.match_networks(passes(spark, sf))
    return A.manifest({"games": read_games(spark, sf), "nodes": nodes, "edges": edges})


@q("reconcile_a16", with_sql(["all_edges", "edges"], """
SELECT 'edges' AS table_name, (SELECT count(*) FROM all_edges) AS expected_rows, (SELECT count(*) FROM edges) AS actual_rows
UNION ALL SELECT 'teams', NULL, count(*) FROM nation"""))
def reconcile(spark, sf):
    rows = passes(spark, sf)
    edges = N.match_networks(rows)[1]
    expected = A.manifest({"edges": N.edge_table(rows), "games": read_games(spark, sf)})
    actual = A.manifest({"edges": edges, "games": read_games(spark, sf), "teams": read_table(spark, sf, "nation")})
    return A.reconcile(expected, actual)


@q("report_sink_a17", with_sql("actions", """
SELECT season, provider, count(DISTINCT game_id) AS games, count(*) AS actions FROM actions GROUP BY 1, 2"""))
def report_sink(spark, sf):
    import uuid

    path = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    A.write_report(A.inventory(read_actions(spark, sf)).drop("actions_per_game"), path, "csv")
    return spark.read.schema("season string, provider string, games long, actions long").csv(path, header=True)


@q("round_report_b13", with_sql("actions", f"""
SELECT game_id, {r('avg(start_x)', 'mean_x', 2)}, {r('stddev_samp(end_x)', 'spread_x', 3)} FROM actions GROUP BY 1"""))
def round_report(spark, sf):
    table = read_actions(spark, sf).groupBy("game_id").agg(
        F.avg("start_x").alias("mean_x"), F.stddev_samp("end_x").alias("spread_x")
    )
    return table.select("game_id", X.rounded("mean_x", 2).alias("mean_x"), X.rounded("spread_x", 3).alias("spread_x"))


# --- composite reports -------------------------------------------------------------------

CTES["fixtures"] = (("games", "clubs"), """
SELECT game_id, rtrim('MW' || game_day || ' ' || coalesce(h.team_name, 'team ' || home_team_id) || ' v '
  || coalesce(a.team_name, 'team ' || away_team_id) || ' (' || strftime(game_date, '%Y-%m-%d') || ') '
  || concat_ws('-', home_score, away_score)) AS fixture
FROM games g LEFT JOIN clubs h ON h.provider = g.provider AND h.team_id = g.home_team_id
LEFT JOIN clubs a ON a.provider = g.provider AND a.team_id = g.away_team_id""")


def fixtures(spark, sf):
    return R.fixture_labels(read_games(spark, sf), teams_of(spark, sf))


@q("fixture_label_m3", with_sql("fixtures", "SELECT * FROM fixtures"))
def fixture_label(spark, sf):
    return fixtures(spark, sf)


@q("review_sheet_m1", with_sql(["labelled", "folds", "fixtures", "named", "clubs"], f"""
SELECT cluster, n.label, {r('n.shot_rate', 'shot_rate')}, game_id, possession_id, fixture, coalesce(c.team_name, 'team ' || p.team_id) AS club,
  {r('start_minute', 'start_minute')}, p.n_actions, ends_in_shot, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS VARCHAR) AS comment
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {mix_sql('game_id', 'possession_id', seed=2)}, game_id, possession_id) AS k
  FROM labelled JOIN folds USING (game_id) WHERE fold = 'test') p
JOIN named n USING (cluster) LEFT JOIN fixtures USING (game_id)
LEFT JOIN clubs c ON c.provider = p.provider AND c.team_id = p.team_id WHERE k <= 6"""))
def review_sheet(spark, sf):
    labelled = staged(folded_chains(spark, sf))
    sheet = R.review_sheet(
        labelled, C.cluster_profiles(labelled, 9), fixtures(spark, sf), teams_of(spark, sf), seed=2
    )
    return X.round_report(sheet)


@q("chain_actions_m2", with_sql(["labelled"], """
SELECT game_id, possession_id, team_id, action_id FROM rated SEMI JOIN (
  SELECT game_id, possession_id, team_id FROM labelled WHERE ends_in_shot) USING (game_id, possession_id, team_id)"""))
def chain_actions(spark, sf):
    rows = chained(spark, sf)
    chosen = C.chain_table(rows).where("ends_in_shot")
    return R.chain_actions(rows, chosen).select("game_id", "possession_id", "team_id", "action_id")


@q("browse_cluster_m4", with_sql("labelled", f"""
SELECT game_id, possession_id, n_actions FROM labelled WHERE cluster = 2 AND ends_in_shot
ORDER BY {mix_sql('game_id', 'possession_id', seed=1)}, game_id, possession_id LIMIT 6"""))
def browse_cluster(spark, sf):
    rows = R.browse_cluster(labelled_chains(spark, sf), 2, only_shots=True, seed=1)
    return rows.select("game_id", "possession_id", "n_actions")


@q("corpus_summary_m5", with_sql(["games", "nodes", "edges"], """
SELECT season, g AS games, coalesce(n, 0) AS nodes, coalesce(e, 0) AS edges FROM (SELECT season, count(*) AS g FROM games GROUP BY 1)
LEFT JOIN (SELECT season, count(*) AS n FROM nodes GROUP BY 1) USING (season)
LEFT JOIN (SELECT season, count(*) AS e FROM edges GROUP BY 1) USING (season)"""))
def corpus_summary(spark, sf):
    return R.corpus_summary(read_games(spark, sf), *N.match_networks(passes(spark, sf)))


@q("club_lookup_m6", with_sql(["nodes", "clubs"], """
SELECT DISTINCT provider, season, team_id, coalesce(team_name, 'team ' || team_id) AS club FROM nodes LEFT JOIN clubs USING (provider, team_id)"""))
def club_lookup(spark, sf):
    return R.club_lookup(N.match_networks(passes(spark, sf))[0], teams_of(spark, sf))


def corpora(spark, sf):
    """Plain state tables of both providers as two corpora, with their folds."""
    table = ST.state_table(read_actions(spark, sf), ST.match_outcomes(read_games(spark, sf)))
    pooled = M.pool_corpora({p: table.where(F.col("provider") == p) for p in ("alpha", "beta")})
    # The second provider's season is short at small scale, so its folds go by match parity.
    return SP.assign_fold(pooled, split(spark, sf))


@q("pooled_corpora_m7", with_sql(["outcomes", "folds", "windows"], """
SELECT provider AS corpus, fold, count(*) AS n_rows, count(DISTINCT game_id) AS games FROM outcomes JOIN folds USING (game_id)
CROSS JOIN windows GROUP BY 1, 2"""))
def pooled_corpora(spark, sf):
    return corpora(spark, sf).groupBy("corpus", "fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("game_id").alias("games")
    )


# --- fitted models -----------------------------------------------------------------------

# A fit itself is beyond SQL. Each query runs the whole job and returns what must hold of its result:
# counts, base rates and losses that SQL works out from the tables, and conditions of an optimum.

MATCH_ROWS = "FROM outcomes JOIN folds USING (game_id) CROSS JOIN windows"


def folded_states(spark, sf):
    return SP.assign_fold(states(spark, sf), split(spark, sf))


def _slopes(model: str, fit):
    """One row for each weight: the slope of the loss, which is 0 at the optimum."""
    return fit.slopes().select(F.lit(model).alias("model"), "class", "feature", "n", F.round("slope", 4) + 0.0).toDF(
        "model", "class", "feature", "n", "slope")


def _slope_sql(model, names, condition):
    listed = ", ".join(["NULL", *(f"'{n}'" for n in names)])
    return f"""SELECT '{model}' AS model, c AS class, f AS feature, n, 0e0 AS slope
FROM (SELECT unnest([0, 1, 2]) AS c), (SELECT unnest([{listed}]) AS f), (SELECT count(*) AS n {MATCH_ROWS} WHERE {condition})"""


@q("logistic_ladder_j2", with_sql(["outcomes", "folds", "windows"], " UNION ALL ".join(
    _slope_sql(rung, S.FEATURE_LADDER[rung], "fold = 'train'") for rung in ("B0", "B1"))))
def logistic_ladder(spark, sf):
    train = durable(folded_states(spark, sf).where(F.col("fold") == "train"))
    fits = [_slopes(rung, M.fit_logistic(train, S.FEATURE_LADDER[rung])) for rung in ("B0", "B1")]
    return fits[0].unionByName(fits[1])


CTES["prior"] = (("outcomes", "folds"), """
SELECT count(*) FILTER (outcome_index = 0) / count(*) AS p0, count(*) FILTER (outcome_index = 1) / count(*) AS p1,
  count(*) FILTER (outcome_index = 2) / count(*) AS p2 FROM outcomes JOIN folds USING (game_id) WHERE fold = 'train'""")
CTES["prior_loss"] = (("prior", "outcomes", "folds", "windows"), f"""
SELECT fold, count(*) AS n, avg(-ln(greatest(1e-15, CASE outcome_index WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END))) AS log_loss
{MATCH_ROWS} CROSS JOIN prior GROUP BY 1""")
_GRID = ", ".join(map(str, M.ROUND_GRID))


@q("boosted_ladder_j3", with_sql("prior_loss", f"""
SELECT rounds, n, {r('log_loss', 'prior_loss')}, TRUE AS chosen_is_least, TRUE AS train_loss_falls
FROM (SELECT unnest([{_GRID}]) AS rounds), prior_loss WHERE fold = 'val'"""))
def boosted_ladder(spark, sf):
    rows = durable(folded_states(spark, sf).where(F.col("fold").isin("train", "val")))
    train, val = rows.where("fold = 'train'"), rows.where("fold = 'val'")
    chosen, model, trace = M.select_rounds(train, val, S.B2_FEATURES)
    fitted = M.capacity_trace(model, train).select("rounds", F.col("log_loss").alias("_train"))
    before = Window.orderBy("rounds")
    least = trace.where(F.col("rounds") == chosen).select(F.col("log_loss").alias("_least"))
    prior = K.score(M.predict_prior(val, train).withColumnRenamed("outcome_index", "y")).select(
        F.col("log_loss").alias("prior_loss"))
    # Four rows, one for each capacity.
    table = attach_row(attach_row(trace.join(fitted, "rounds"), least), prior)
    return X.round_report(table.select(
        "rounds", "n", "prior_loss", (F.col("_least") <= F.col("log_loss")).alias("chosen_is_least"),
        (F.col("_train") < F.coalesce(F.lag("_train").over(before), F.lit(float("inf")))).alias("train_loss_falls"),
    ))


_LISTED = ", ".join(f"'{n}'" for n in S.B2_FEATURES)


@q("permutation_importance_j6", f"""
SELECT unnest([{_LISTED}]) AS feature, TRUE AS spread_is_known, TRUE AS rise_within_losses""")
def importance(spark, sf):
    train = durable(folded_states(spark, sf).where(F.col("fold") == "train"))
    table = M.permutation_importance(train)
    # Shuffling one feature cannot do better than no loss at all, nor move a prediction beyond the clip.
    return table.select(
        "feature", (F.col("importance_std") >= 0).alias("spread_is_known"),
        F.abs("importance_mean").between(0.0, 35.0).alias("rise_within_losses"))


def nearest_mean(labelled, key, vector):
    """(key, whether the mean of its own cluster is a nearest one): what k-means ends with."""
    means = V.mean_vectors(labelled, ["cluster"], vector, "_m").select(
        F.array_sort(F.collect_list(F.struct("cluster", "_m")).over(Window.partitionBy())).alias("_all")).limit(1)
    gap = "aggregate(zip_with({0}, m._m, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v)".format(vector)
    # A dozen centroids in one row.
    return attach_row(labelled, means).withColumn(
        "_d", F.expr(f"transform(_all, m -> {gap})")
    ).select(key, (F.expr("_d[array_position(transform(_all, m -> m.cluster), cluster) - 1]")
                   <= F.array_min("_d") * (1 + 1e-9) + 1e-12).alias("nearest"))


@q("kmeans_j7", "SELECT vec_id, TRUE AS nearest FROM embeddings")
def kmeans(spark, sf):
    labelled = staged(M.fit_clusters(vectors(spark, sf), "embedding", 8, tolerance=0.0))
    return nearest_mean(labelled, "vec_id", "scaled")


def chain_vectors(spark, sf):
    rows = folded_chains(spark, sf)
    return rows.drop("cluster").withColumn("vector", M.feature_array(S.CHAIN_FEATURES))


_KS = ", ".join(map(str, M.K_VALUES))
CTES["chain_base"] = (("labelled", "folds"), """
SELECT count(*) FILTER (fold = 'train') AS n_train, count(*) FILTER (fold = 'test') AS n_test,
  count(*) FILTER (fold = 'train' AND ends_in_shot) / count(*) FILTER (fold = 'train') AS base_rate_train,
  count(*) FILTER (fold = 'test' AND ends_in_shot) / count(*) FILTER (fold = 'test') AS base_rate_test
FROM labelled JOIN folds USING (game_id)""")


@q("k_sweep_j8", with_sql("chain_base", f"""
SELECT 'hand-crafted' AS representation, unnest([{_KS}]) AS k, n_train, n_test, {r('base_rate_train', 'base_rate_train')},
  {r('base_rate_test', 'base_rate_test')}, TRUE AS silhouette_in_range, TRUE AS spread_in_range, TRUE AS some_lift FROM chain_base"""))
def k_sweep(spark, sf):
    table = M.sweep_k(chain_vectors(spark, sf), "vector", representation="hand-crafted")
    return X.round_report(table.select(
        "representation", "k", "n_train", "n_test", "base_rate_train", "base_rate_test",
        F.col("silhouette").between(-1.0, 1.0).alias("silhouette_in_range"),
        (F.col("shot_rate_spread_train").between(0.0, 1.0) & F.col("shot_rate_spread_test").between(0.0, 1.0)).alias("spread_in_range"),
        (F.col("max_lift_test") >= 1.0).alias("some_lift"),
    ))


@q("cluster_and_score_j9", f"""
SELECT 'embedding' AS representation, unnest([{_KS}]) AS k, TRUE AS scores_in_range, TRUE AS silhouette_in_range""")
def cluster_and_score(spark, sf):
    table = M.cluster_and_score(
        vectors(spark, sf).withColumn("half", F.col("label") % 4), "embedding", "half", "label",
        representation="embedding")
    scores = [F.col(c).between(low, 1.0) for c, low in (("ari_coarse", -0.5), ("ari_fine", -0.5), ("nmi_coarse", 0.0), ("nmi_fine", 0.0))]
    return table.select(
        "representation", "k", (scores[0] & scores[1] & scores[2] & scores[3]).alias("scores_in_range"),
        F.col("silhouette").between(-1.0, 1.0).alias("silhouette_in_range"))


_SETS = ", ".join(f"'{name}'" for name in S.FEATURE_SETS)


@q("role_ablation_j10", with_sql(["nodes", "lineup", "folds"], f"""
SELECT unnest([{_SETS}]) AS feature_set, fold, n, TRUE AS fits_train, TRUE AS scores_in_range FROM (
  SELECT fold, count(*) AS n FROM nodes JOIN lineup USING (season, provider, player_id) JOIN folds USING (game_id)
  WHERE fold <> 'unused' GROUP BY 1)"""))
def role_ablation(spark, sf):
    from pitchloom.plans.threat_plans import full_network

    features, edges = full_network(spark, sf)
    rows = FE.role_features(features, directory(spark, sf)).drop("fine_position")
    table = M.role_ablation(SP.assign_fold(rows, split(spark, sf)), edges)
    # Trained on four classes: better than a coin of four sides on its own rows.
    return table.select(
        "feature_set", "fold", "n", ((F.col("fold") != "train") | (F.col("accuracy") > 0.25)).alias("fits_train"),
        (F.col("accuracy").between(0.0, 1.0) & (F.col("log_loss") > 0)).alias("scores_in_range"))


FRACTIONS = (0.0625, 0.125, 0.25, 0.5, 0.75, 1.0)


@q("learning_curve_j11", with_sql(["outcomes", "folds", "windows"], f"""
SELECT model, fraction, draw, wanted AS n_matches, n, TRUE AS loss_in_range
FROM (SELECT unnest(['B0', 'B1', 'B2']) AS model), (SELECT unnest([{', '.join(f'{f}e0' for f in FRACTIONS)}]) AS fraction),
  (SELECT unnest([0, 1, 2]) AS draw), (SELECT count(*) AS n {MATCH_ROWS} WHERE fold = 'test'), LATERAL (
  SELECT CAST(least(greatest(floor(fraction * size + 0.5), 20), size) AS BIGINT) AS wanted, size
  FROM (SELECT count(*) AS size FROM outcomes JOIN folds USING (game_id) WHERE fold = 'train'))
WHERE wanted < size OR draw = 0"""))
def learning_curve(spark, sf):
    curve = M.learning_curve(folded_states(spark, sf), FRACTIONS)
    return curve.select(
        "model", "fraction", "draw", "n_matches", "n", F.col("log_loss").between(0.0, 35.0).alias("loss_in_range"))


@q("pooled_vs_single_j12", with_sql(["outcomes", "folds", "windows"], f"""
{_slope_sql('single', S.B1_FEATURES, "fold = 'train' AND provider = 'alpha'")}
UNION ALL {_slope_sql('pooled', S.B1_FEATURES, "fold = 'train'")}"""))
def pooled_vs_single(spark, sf):
    _, own, everyone = M.pooled_fits(corpora(spark, sf), "alpha")
    return _slopes("single", own).unionByName(_slopes("pooled", everyone))


def axes_report(placed, column, parts):
    """(component, length, how far from right angles with the others, share of variance is that of the placed
    rows, and falls)."""
    spread = placed.select(F.posexplode(column).alias("component", "_x")).groupBy("component").agg(
        F.var_samp("_x").alias("variance"))
    others = parts.select(F.col("component").alias("_o"), F.col("weights").alias("_w"))
    # A few dozen components.
    crossed = parts.join(others, F.col("component") != F.col("_o")).groupBy("component").agg(
        F.max(F.abs(V.dot("weights", "_w"))).alias("slant"))
    total = parts.join(spread, "component").agg((F.sum("variance") / F.sum("share")).alias("_total"))
    table = attach_row(parts.join(spread, "component").join(crossed, "component"), total)
    return table.select(
        "component", F.round(V.dot("weights", "weights"), 6).alias("length"), (F.round("slant", 6) + 0.0).alias("slant"),
        "variance", (F.abs(F.col("variance") - F.col("share") * F.col("_total")) <= 1e-6 * F.col("_total")).alias("share_holds"))


@q("sequence_embedding_j13", "SELECT CAST(unnest(range(32)) AS INTEGER) AS component, 1e0 AS length, 0e0 AS slant, TRUE AS share_holds")
def sequence_embedding(spark, sf):
    rows = staged(chained(spark, sf))
    placed, parts = M.sequence_embedding(staged(C.chain_sequences(rows, C.chain_table(rows))))
    return axes_report(placed, "embedding", parts).drop("variance")


# The variance along the first two axes, from powers of the covariance matrix: squared 40 times for the
# first axis, and again with that axis taken out for the second.
CTES["cov"] = (("scaled",), """
SELECT x.i AS a, y.i AS b, sum(x.z * y.z) / (count(*) - 1) AS v FROM scaled x JOIN scaled y USING (vec_id) GROUP BY 1, 2""")


def _powers(name, matrix):
    CTES[f"{name}_powers"] = ((matrix,), f"""
SELECT 0 AS step, a, b, v FROM {matrix}
UNION ALL SELECT step + 1, a, b, v / max(abs(v)) OVER () FROM (
  SELECT x.step, x.a, y.b, sum(x.v * y.v) AS v FROM {name}_powers x JOIN {name}_powers y ON y.a = x.b WHERE x.step < 40 GROUP BY 1, 2, 3)""")
    CTES[f"{name}_axis"] = ((f"{name}_powers",), f"""
SELECT b AS i, w / sqrt(sum(w * w) OVER ()) AS w FROM (
  SELECT b, sum(v * (1 + a / 97e0)) AS w FROM {name}_powers WHERE step = 40 GROUP BY 1)""")
    CTES[f"{name}_value"] = ((f"{name}_axis", matrix), f"""
SELECT sum(c.v * x.w * y.w) AS v FROM {matrix} c JOIN {name}_axis x ON x.i = c.a JOIN {name}_axis y ON y.i = c.b""")


_powers("axis1", "cov")
CTES["cov2"] = (("cov", "axis1_axis", "axis1_value"), """
SELECT a, b, c.v - l.v * x.w * y.w AS v FROM cov c JOIN axis1_axis x ON x.i = c.a JOIN axis1_axis y ON y.i = c.b, axis1_value l""")
_powers("axis2", "cov2")


@q("projection_j14", with_sql(["axis1_value", "axis2_value"], """
SELECT CAST(0 AS INTEGER) AS component, 1e0 AS length, 0e0 AS slant, round(v, 4) AS variance, TRUE AS share_holds FROM axis1_value
UNION ALL SELECT 1, 1e0, 0e0, round(v, 4), TRUE FROM axis2_value"""))
def projection(spark, sf):
    placed, parts = M.projection(vectors(spark, sf), "embedding")
    return axes_report(staged(placed), "projection", parts).withColumn("variance", F.round("variance", 4))
