"""Queries on scores, calibration, agreement, stability and provider reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitchloom import schema as S
from pitchloom.functions import expressions as X
from pitchloom.functions.hashing import mix, mix_sql
from pitchloom.operators import (
    harmonise as H, models as M, scores as K, sequence as Q, similarity as V,
)
from pitchloom.plans.book import Book
from pitchloom.plans.sqlkit import (
    CTES, COMPARABLE, DONE, LENGTH, NK, OK, PASS, SHOT, quoted, r, ratio, with_sql,
)
from pitchloom.plans.stream_plans import _rand_sql, chained, passes
from pitchloom.plans.threat_plans import labelled_chains, scored_states, split
from pitchloom.operators import chains as C, splits as SP
from pitchloom.runtime import durable
from pitchloom.sources.event_actions import read_actions, read_games, read_table

BOOK = Book()
q = BOOK.add
DRAWS = 400


def predictions(spark, sf):
    """A score-driven rule and a constant rule, side by side."""
    rows = scored_states(spark, sf).withColumnRenamed("outcome_index", "y")
    flat = F.array(F.lit(0.45), F.lit(0.25), F.lit(0.3))
    return rows.withColumn("model", F.lit("rule")).unionByName(
        rows.withColumn("probabilities", flat).withColumn("model", F.lit("flat"))
    )


CTES["preds"] = (("scored",), """
SELECT game_id, season, window_index, checkpoint_minute, outcome_index AS y, 'rule' AS model, p0, p1, p2 FROM scored
UNION ALL SELECT game_id, season, window_index, checkpoint_minute, outcome_index, 'flat', 45e-2, 25e-2, 3e-1 FROM scored""")
_BIN = " + ".join(f"CASE WHEN confidence > {i} * 1e-1 THEN 1 ELSE 0 END" for i in range(1, 10))
CTES["rowed"] = (("preds",), f"""
SELECT *, {_BIN} AS bin FROM (
  SELECT *, -ln(CASE y WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END) AS loss,
    pow(c0 - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2) + pow(c1 - CASE WHEN y = 1 THEN 1 ELSE 0 END, 2)
      + pow(c2 - CASE WHEN y = 2 THEN 1 ELSE 0 END, 2) AS brier, greatest(c0, c1, c2) AS confidence,
    CASE WHEN (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END) = y THEN 1e0 ELSE 0e0 END AS hit,
    CASE WHEN (CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END) = y THEN 1e0 ELSE 0e0 END AS top_hit
  FROM (SELECT *, greatest(1e-15, least(1, p0)) / s AS c0, greatest(1e-15, least(1, p1)) / s AS c1, greatest(1e-15, least(1, p2)) / s AS c2
    FROM (SELECT *, greatest(1e-15, least(1, p0)) + greatest(1e-15, least(1, p1)) + greatest(1e-15, least(1, p2)) AS s FROM preds)))""")


def _score_sql(keys):
    return f"""
SELECT {keys}, CAST(sum(n) AS BIGINT) AS n, sum(loss) / sum(n) AS log_loss, sum(brier) / sum(n) AS brier,
  sum(hit) / sum(n) AS accuracy, sum(abs(top_hit - confidence)) / sum(n) AS ece
FROM (SELECT {keys}, bin, count(*) AS n, sum(loss) AS loss, sum(brier) AS brier, sum(hit) AS hit,
  sum(top_hit) AS top_hit, sum(confidence) AS confidence FROM rowed GROUP BY {keys}, bin) GROUP BY {keys}"""


CTES["by_model"] = (("rowed",), _score_sql("model"))


@q("log_loss_brier_accuracy_k1", with_sql("by_model", f"""
SELECT model, n, {r('log_loss', 'log_loss')}, {r('brier', 'brier')}, {r('accuracy', 'accuracy')} FROM by_model"""))
def log_loss(spark, sf):
    return X.round_report(K.score(predictions(spark, sf), ["model"]).drop("ece"))


@q("ece_k2", with_sql("by_model", f"SELECT model, {r('ece', 'ece')} FROM by_model"))
def ece(spark, sf):
    return X.round_report(K.score(predictions(spark, sf), ["model"]).select("model", "ece"))


@q("reliability_curve_k3", with_sql("rowed", f"""
SELECT model, {r('bin / 10e0', 'bin_low')}, {r('(bin + 1) / 10e0', 'bin_high')}, count(*) AS n,
  {r('avg(confidence)', 'mean_confidence')}, {r('avg(top_hit)', 'observed_accuracy')} FROM rowed GROUP BY model, bin"""))
def reliability(spark, sf):
    return X.round_report(K.reliability_curve(predictions(spark, sf), ["model"]))


@q("document_quality_scores_k1", f"""
SELECT lang, count(*) AS n, {r('avg(-ln(CASE WHEN quality = 1 THEN p ELSE 1 - p END))', 'log_loss')},
  {r('avg(CASE WHEN (p > 0.5) = (quality = 1) THEN 1e0 ELSE 0 END)', 'accuracy')}
FROM (SELECT lang, quality, 0.05 + (n_chars % 97) / 110e0 AS p FROM labels JOIN documents USING (doc_id)) GROUP BY lang""")
def document_scores(spark, sf):
    p = F.lit(0.05) + (F.col("n_chars") % 97) / F.lit(110.0)
    rows = (
        read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
        .join(read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
        .withColumn("probabilities", F.array(1 - p, p))
    )
    return X.round_report(K.score(rows, ["lang"]).select("lang", "n", "log_loss", "accuracy"))


@q("per_checkpoint_k4", with_sql("rowed", f"""
SELECT {r('checkpoint_minute', 'checkpoint_minute')}, n, {r('log_loss', 'log_loss')}, {r('brier', 'brier')},
  {r('accuracy', 'accuracy')}, {r('ece', 'ece')} FROM ({_score_sql('checkpoint_minute')})"""))
def per_checkpoint(spark, sf):
    return X.round_report(K.per_checkpoint(predictions(spark, sf)))


def _draw_counts(units, seeds=(3,)):
    """(seed, draw, game_id, times): how often a draw takes a match."""
    parts = [f"SELECT {s} AS seed, draw, game_id, {mix_sql('draw', 'game_id', seed=s)} AS h FROM "
             f"(SELECT unnest(range({DRAWS})) AS draw), (SELECT DISTINCT game_id FROM {units})" for s in seeds]
    times = " + ".join(f"CASE WHEN h >= {bound} THEN 1 ELSE 0 END" for bound in K.poisson_bounds())
    return f"SELECT seed, draw, game_id, {times} AS times FROM ({' UNION ALL '.join(parts)})"


CTES["units"] = (("rowed",), "SELECT model, game_id, sum(loss) AS total, count(*) AS n FROM rowed GROUP BY 1, 2")
CTES["draw_counts"] = (("units",), _draw_counts("units"))
CTES["draw_values"] = (("draw_counts", "units"), """
SELECT model, draw, sum(total * times) / sum(n * times) AS v FROM draw_counts
JOIN units USING (game_id) WHERE times > 0 GROUP BY 1, 2""")
CTES["intervals"] = (("draw_values",), """
SELECT model, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM draw_values GROUP BY 1""")


@q("bootstrap_by_match_k5", with_sql(["intervals", "units"], f"""
SELECT model, {r('point', 'point')}, {r('lo', 'ci_low')}, {r('hi', 'ci_high')}, n_matches FROM intervals JOIN (
  SELECT model, sum(total) / sum(n) AS point, count(*) AS n_matches FROM units GROUP BY 1) USING (model)"""))
def bootstrap(spark, sf):
    return X.round_report(K.bootstrap_by_match(predictions(spark, sf), ["model"], DRAWS, seed=3))


@q("compare_models_k6", with_sql(["intervals", "by_model", "units"], f"""
SELECT model, n AS n_rows, {r('log_loss', 'log_loss')}, {r('brier', 'brier')}, {r('accuracy', 'accuracy')}, {r('ece', 'ece')},
  {r('lo', 'log_loss_ci_low')}, {r('hi', 'log_loss_ci_high')}, (SELECT count(DISTINCT game_id) FROM units) AS n_matches
FROM by_model JOIN intervals USING (model)"""))
def compare_models(spark, sf):
    return X.round_report(K.compare_models(predictions(spark, sf), DRAWS, seed=3))


CTES["paired"] = (("units",), """
SELECT game_id, sum(CASE WHEN model = 'rule' THEN total ELSE -total END) AS total,
  sum(CASE WHEN model = 'rule' THEN n END) AS n FROM units GROUP BY 1""")
_PAIRED = """
SELECT p AS delta_log_loss, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM (
  SELECT seed, draw, sum(total * times) / sum(n * times) AS v FROM {counts} JOIN paired USING (game_id)
  WHERE times > 0 GROUP BY 1, 2), (SELECT sum(total) / sum(n) AS p FROM paired) GROUP BY seed, p"""


@q("paired_difference_k7", with_sql(["draw_counts", "paired"], f"""
SELECT {r('delta_log_loss', 'delta_log_loss')}, {r('lo', 'ci_low')}, {r('hi', 'ci_high')}, lo > 0 OR hi < 0 AS significant
FROM ({_PAIRED.format(counts='draw_counts')})"""))
def paired_difference(spark, sf):
    return X.round_report(K.paired_difference(predictions(spark, sf), "rule", "flat", DRAWS, seed=3))


CTES["seed_counts"] = (("units",), _draw_counts("units", (1, 2, 3)))


@q("paired_over_seeds_k17", with_sql(["seed_counts", "paired"], f"""
SELECT 'rule' AS model, {r('avg(delta_log_loss)', 'mean_delta')}, {r('min(lo)', 'ci_low')}, {r('max(hi)', 'ci_high')},
  count(*) FILTER (lo > 0 OR hi < 0) AS n_significant, count(*) AS n_seeds FROM ({_PAIRED.format(counts='seed_counts')})"""))
def paired_over_seeds(spark, sf):
    rows = durable(predictions(spark, sf))
    parts = [
        K.paired_difference(rows, "rule", "flat", DRAWS, seed).withColumn("model", F.lit("rule"))
        for seed in (1, 2, 3)
    ]
    table = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return X.round_report(K.paired_over_seeds(table))


def bucketed(spark, sf):
    """Vectors with their label and a fixed bucket in place of a fitted cluster."""
    return read_table(spark, sf, "embeddings").select(
        "vec_id", "label", "embedding",
        F.when(F.col("vec_id") % 7 != 0, (F.col("label") + F.floor(F.col("embedding")[0] * 4)) % 5).cast("long").alias("bucket"),
    )


CTES["bucketed"] = ((), """
SELECT vec_id, label, embedding, CASE WHEN vec_id % 7 <> 0 THEN CAST((label + floor(CAST(embedding[1] * 4 AS FLOAT))) % 5 AS BIGINT) END AS bucket
FROM embeddings""")
CTES["known"] = (("bucketed",), "SELECT *, 0 AS one FROM bucketed WHERE bucket IS NOT NULL")


@q("adjusted_rand_k8", with_sql("known", f"SELECT {r('adjusted_rand', 'adjusted_rand')} FROM {_rand_sql('known', 'label', 'bucket', 'one')}"))
def adjusted_rand(spark, sf):
    known = bucketed(spark, sf).where(F.col("bucket").isNotNull())
    return X.round_report(Q.adjusted_rand(known, "label", "bucket"))


@q("nmi_k9", with_sql("known", f"""
SELECT {r('mi / ((ha + hb) / 2)', 'nmi')} FROM (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM (
    SELECT CAST(count(*) AS DOUBLE) AS n, label, bucket FROM known GROUP BY label, bucket)
  JOIN (SELECT label, CAST(count(*) AS DOUBLE) AS na FROM known GROUP BY 1) USING (label)
  JOIN (SELECT bucket, CAST(count(*) AS DOUBLE) AS nb FROM known GROUP BY 1) USING (bucket),
  (SELECT CAST(count(*) AS DOUBLE) AS t FROM known)),
 (SELECT -sum(n / t * ln(n / t)) AS ha FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM known GROUP BY label), (SELECT CAST(count(*) AS DOUBLE) AS t FROM known)),
 (SELECT -sum(n / t * ln(n / t)) AS hb FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM known GROUP BY bucket), (SELECT CAST(count(*) AS DOUBLE) AS t FROM known))"""))
def nmi(spark, sf):
    known = bucketed(spark, sf).where(F.col("bucket").isNotNull())
    return X.round_report(K.normalized_mutual_info(known, "label", "bucket"))


CTES["lift"] = (("labelled", "folds"), """
SELECT fold, cluster, n_chains, n_chains / tn AS share, rate AS shot_rate, greatest(0, c - s) AS ci_low, least(1, c + s) AS ci_high,
  base AS base_rate, rate / nullif(base, 0) AS lift, greatest(0, c - s) > base OR least(1, c + s) < base AS differs FROM (
  SELECT *, (rate + 3.8416 / (2 * n_chains)) / (1 + 3.8416 / n_chains) AS c,
    196e-2 * sqrt(rate * (1 - rate) / n_chains + 3.8416 / (4e0 * n_chains * n_chains)) / (1 + 3.8416 / n_chains) AS s FROM (
    SELECT fold, cluster, n_chains, k / n_chains AS rate, sum(n_chains) OVER (PARTITION BY fold) AS tn,
      sum(k) OVER (PARTITION BY fold) / sum(n_chains) OVER (PARTITION BY fold) AS base FROM (
      SELECT fold, cluster, CAST(count(*) AS DOUBLE) AS n_chains, CAST(count(*) FILTER (ends_in_shot) AS DOUBLE) AS k
      FROM labelled JOIN folds USING (game_id) GROUP BY 1, 2)))""")


def folded_chains(spark, sf):
    return SP.assign_fold(labelled_chains(spark, sf), split(spark, sf))


@q("shot_lift_k10", with_sql("lift", f"""
SELECT fold, cluster, CAST(n_chains AS BIGINT) AS n_chains, {', '.join(r(c, c) for c in ('share', 'shot_rate', 'ci_low', 'ci_high', 'base_rate', 'lift'))},
  differs AS differs_from_base FROM lift"""))
def shot_lift(spark, sf):
    return X.round_report(K.shot_lift(folded_chains(spark, sf), ["fold"]))


_SIDE = "(SELECT cluster, CAST(n_chains AS BIGINT) AS n, shot_rate AS sr, share AS sh, ci_low AS lo, ci_high AS hi FROM lift WHERE fold = '{f}')"


@q("fold_stability_k11", with_sql("lift", f"""
SELECT cluster, a.n AS n_chains_train, b.n AS n_chains_test, {r('a.sr', 'shot_rate_train')}, {r('b.sr', 'shot_rate_test')},
  {r('b.sr - a.sr', 'shot_rate_delta')}, {r('a.sh', 'share_train')}, {r('b.sh', 'share_test')}, {r('b.sh / nullif(a.sh, 0)', 'share_ratio')},
  coalesce(b.lo <= a.hi AND a.lo <= b.hi, FALSE) AS rate_stable
FROM {_SIDE.format(f='train')} a FULL JOIN {_SIDE.format(f='test')} b USING (cluster)"""))
def fold_stability(spark, sf):
    return X.round_report(K.fold_stability(folded_chains(spark, sf)))


# --- vectors -----------------------------------------------------------------------------

CTES["long_vec"] = ((), "SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)")
CTES["moments"] = (("long_vec",), """
SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-6 THEN 1 ELSE stddev_pop(v) END AS s FROM long_vec GROUP BY 1""")
CTES["scaled"] = (("long_vec", "moments"), "SELECT vec_id, label, i, (v - m) / s AS z FROM long_vec JOIN moments USING (i)")
CTES["unit_vec"] = (("scaled",), "SELECT *, z / sqrt(sum(z * z) OVER (PARTITION BY vec_id)) AS u FROM scaled")


def vectors(spark, sf):
    return read_table(spark, sf, "embeddings")


@q("standardise_j1", with_sql("scaled", f"""
SELECT vec_id, {r('sum(z * i)', 'checksum')}, {r('sum(z * z)', 'norm')} FROM scaled GROUP BY vec_id"""))
def standardise(spark, sf):
    rows = V.standardise(vectors(spark, sf), "embedding")
    return X.round_report(
        rows.select(
            "vec_id",
            F.expr("aggregate(transform(scaled, (z, i) -> z * (i + 1)), 0D, (a, v) -> a + v)").alias("checksum"),
            V.dot("scaled", "scaled").alias("norm"),
        )
    )


@q("within_entity_consistency_k12", with_sql("unit_vec", f"""
SELECT count(*) AS n_players, {r('avg(same)', 'same_player_cosine')}, {r('avg(other)', 'diff_player_cosine')}, {r('avg(same) - avg(other)', 'lift')}
FROM (SELECT a.label, avg(CASE WHEN a.label = b.label THEN c END) AS same, avg(CASE WHEN a.label <> b.label THEN c END) AS other
  FROM (SELECT x.vec_id AS p, y.vec_id AS q_, sum(x.u * y.u) AS c FROM unit_vec x JOIN unit_vec y ON x.i = y.i AND x.vec_id <> y.vec_id GROUP BY 1, 2) t
  JOIN embeddings a ON a.vec_id = t.p JOIN embeddings b ON b.vec_id = t.q_ GROUP BY 1)"""))
def within_entity(spark, sf):
    return X.round_report(V.within_entity_consistency(vectors(spark, sf), "label", "embedding"))


def seasoned(spark, sf):
    """Vectors of 'players' (50 per label) over 38 weeks and two providers."""
    return vectors(spark, sf).select(
        (F.col("label") * 50 + F.floor(F.col("vec_id") / 10) % 50).cast("long").alias("player_id"),
        (mix("vec_id", seed=9) % 38 + 1).cast("int").alias("week"),
        F.when(F.col("vec_id") % 2 == 0, "alpha").otherwise("beta").alias("provider"), "embedding", "vec_id",
    )


CTES["seasoned"] = (("scaled",), f"""
SELECT vec_id, i, z, CAST(label * 50 + (vec_id // 10) % 50 AS BIGINT) AS player_id, {mix_sql('vec_id', seed=9)} % 38 + 1 AS week,
  CASE WHEN vec_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider FROM scaled""")


def _stability(first, second):
    unit = "m / sqrt(sum(m * m) OVER (PARTITION BY player_id))"
    return f"""
WITH a AS (SELECT player_id, i, {unit} AS u FROM (SELECT player_id, i, avg(z) AS m FROM seasoned WHERE {first} GROUP BY 1, 2)),
  b AS (SELECT player_id, i, {unit} AS u FROM (SELECT player_id, i, avg(z) AS m FROM seasoned WHERE {second} GROUP BY 1, 2)),
  p AS (SELECT player_id, i, a.u AS l, b.u AS r FROM a JOIN b USING (player_id, i))
SELECT n AS n_players, {r('m', 'matched_cosine')}, {r('s', 'shuffled_cosine')}, {r('m - s', 'lift')} FROM (
  SELECT count(DISTINCT player_id) AS n, sum(l * r) / count(DISTINCT player_id) AS m FROM p),
  (SELECT sum(x * y) AS s FROM (SELECT i, avg(l) AS x, avg(r) AS y FROM p GROUP BY 1))"""


def _nested(sql):
    """A final select that starts with its own WITH joins the outer list."""
    head, tail = sql.rsplit(")\nWITH ", 1)
    return f"{head}),\n{tail}"


@q("half_season_stability_k13", _nested(with_sql("seasoned", _stability("week < 20", "week >= 20"))))
def half_season(spark, sf):
    return X.round_report(V.half_season_stability(seasoned(spark, sf), "embedding"))


@q("cross_season_stability_k14", _nested(with_sql("seasoned", _stability("provider = 'alpha'", "provider = 'beta'"))))
def cross_season(spark, sf):
    rows = seasoned(spark, sf)
    pairs = rows.select(F.col("player_id").alias("player_id_left")).distinct().withColumn(
        "player_id_right", F.col("player_id_left")
    )
    return X.round_report(V.cross_season_stability(rows, "embedding", pairs, "alpha", "beta"))


@q("cosine_top_k_k15", with_sql("unit_vec", f"""
SELECT vec_id, label, {r('c', 'cosine')} FROM (SELECT x.vec_id, x.label, sum(x.u * y.u) AS c FROM unit_vec x
  JOIN unit_vec y ON x.i = y.i AND y.vec_id = 7 WHERE x.vec_id <> 7 GROUP BY 1, 2) ORDER BY c DESC, vec_id LIMIT 10"""))
def cosine_top_k(spark, sf):
    best = V.nearest(vectors(spark, sf), "vec_id", "embedding", 7)
    return X.round_report(best.select("vec_id", "label", "cosine"))


@q("cosine_all_k15", with_sql("unit_vec", f"""
SELECT vec_id, place, neighbour, {r('c', 'cosine')} FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour) AS place FROM (
    SELECT x.vec_id, y.vec_id AS neighbour, round(sum(x.u * y.u), {V.COSINE_DIGITS}) AS c FROM unit_vec x
    JOIN unit_vec y ON x.i = y.i AND x.vec_id <> y.vec_id GROUP BY 1, 2)) WHERE place <= 5"""))
def cosine_all(spark, sf):
    return X.round_report(V.nearest_all(vectors(spark, sf), "vec_id", "embedding", 5, exact=True))


CTES["label_centroids"] = (("scaled",), """
SELECT label || '/' || provider AS who, provider, i, avg(z) AS m FROM (
  SELECT *, CASE WHEN vec_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS provider FROM scaled) GROUP BY 1, 2, 3 HAVING count(*) >= 10""")
CTES["unit_centroids"] = (("label_centroids",), "SELECT *, m / sqrt(sum(m * m) OVER (PARTITION BY who)) AS u FROM label_centroids")


@q("nearest_centroids_k15", with_sql("unit_centroids", f"""
SELECT who, place, neighbour, {r('c', 'cosine')} FROM (
  SELECT *, row_number() OVER (PARTITION BY who ORDER BY c DESC, neighbour) AS place FROM (
    SELECT x.who, y.who AS neighbour, round(sum(x.u * y.u), {V.COSINE_DIGITS}) AS c FROM unit_centroids x
    JOIN unit_centroids y ON x.i = y.i AND x.provider <> y.provider GROUP BY 1, 2)) WHERE place <= 10"""))
def nearest_centroids(spark, sf):
    """For every label of at least ten rows the most similar ones of the other provider."""
    rows = vectors(spark, sf).withColumn(
        "provider", F.when(F.col("vec_id") % 2 == 0, "alpha").otherwise("beta")
    ).withColumn("who", F.concat_ws("/", F.col("label").cast("string"), "provider"))
    table = V.centroids(rows, ["who", "provider"], "embedding")
    return X.round_report(V.nearest_all(table, "who", "centroid", 10, other="provider", scale=False))


@q("compare_representations_k16", with_sql("by_model", f"""
SELECT representation, k, {r('log_loss', 'log_loss')} FROM (
  SELECT model AS representation, CAST(4 AS INTEGER) AS k, log_loss FROM by_model
  UNION ALL SELECT model, 8, log_loss FROM by_model)"""))
def compare_representations(spark, sf):
    base = K.score(predictions(spark, sf), ["model"]).select(F.col("model").alias("representation"), "log_loss")
    tables = [base.select("representation", F.lit(k).alias("k"), "log_loss") for k in (8, 4)]
    return X.round_report(K.compare_representations(*tables))


@q("over_seeds_k16", with_sql("rowed", f"""
SELECT model, {r('avg(l)', 'log_loss_mean')}, {r('stddev_samp(l)', 'log_loss_std')}, count(*) AS n_seeds FROM (
  SELECT model, season, avg(loss) AS l FROM rowed GROUP BY 1, 2) GROUP BY 1"""))
def over_seeds(spark, sf):
    per = K.score(predictions(spark, sf), ["model", "season"]).withColumnRenamed("season", "seed")
    return X.round_report(K.over_seeds(per, ["model"], ["log_loss"]))


# --- provider reports --------------------------------------------------------------------


@q("basic_counts_l1", with_sql("actions", f"""
SELECT season, provider, count(DISTINCT game_id) AS games, count(*) AS actions, {r('count(*) / count(DISTINCT game_id)', 'actions_per_game')},
  {r(f'count(*) FILTER ({PASS}) / count(DISTINCT game_id)', 'passes_per_game')},
  {r(ratio(f'count(*) FILTER ({DONE})', f'count(*) FILTER ({PASS})'), 'pass_completion')},
  {r("count(*) FILTER (type_name = 'dribble') / count(DISTINCT game_id)", 'dribbles_per_game')} FROM actions GROUP BY 1, 2"""))
def basic_counts(spark, sf):
    return X.round_report(H.basic_counts(read_actions(spark, sf)))


@q("recipient_coverage_l2", with_sql("passes", f"""
SELECT season, provider, count(*) AS completed_passes, count(recipient_id) AS resolved, {r('count(recipient_id) / count(*)', 'resolved_pct')}
FROM passes WHERE {DONE} GROUP BY 1, 2"""))
def coverage(spark, sf):
    return X.round_report(H.recipient_coverage(passes(spark, sf)))


CTES["mix_rates"] = (("actions",), """
SELECT type_name, max(CASE WHEN provider = 'alpha' THEN c / g END) AS l, max(CASE WHEN provider = 'beta' THEN c / g END) AS r
FROM (SELECT type_name, provider, CAST(count(*) AS DOUBLE) AS c FROM actions GROUP BY 1, 2)
JOIN (SELECT provider, count(DISTINCT game_id) AS g FROM actions GROUP BY 1) USING (provider) GROUP BY 1""")


@q("action_mix_l3", with_sql("mix_rates", f"""
SELECT type_name, {r('l', 'per_game_left')}, {r('r', 'per_game_right')}, {r('l / nullif(r, 0)', 'rate_ratio')},
  coalesce(round(l / nullif(r, 0), 2) BETWEEN 0.75e0 AND 1.33e0, FALSE) AS provider_comparable FROM mix_rates"""))
def action_mix(spark, sf):
    return X.round_report(H.action_mix(read_actions(spark, sf), "alpha", "beta"))


def _family(name, condition):
    return f"SELECT '{name}' AS family, {r('sum(l)', 'left_rate')}, {r('sum(r)', 'right_rate')}, {r('sum(l) / nullif(sum(r), 0)', 'ratio')} FROM mix_rates WHERE {condition}"


@q("aggregate_rates_l5", with_sql("mix_rates", _family("pass_like", PASS) + " UNION ALL " + _family("comparable", COMPARABLE)))
def aggregate_rates(spark, sf):
    return X.round_report(H.aggregate_rates(H.action_mix(read_actions(spark, sf), "alpha", "beta")))


CTES["shift"] = (("actions",), " UNION ALL ".join(
    f"SELECT '{n}' AS feature, provider = 'alpha' AS l, round({e}, 9) AS v FROM actions WHERE {e} IS NOT NULL AND {c}"
    for n, e, c in (("start_x", "start_x", "TRUE"), ("start_y", "start_y", "TRUE"), ("pass_length", LENGTH, PASS), ("pass_dx", "(end_x - start_x)", PASS))))


@q("ks_shift_l4", with_sql("shift", f"""
SELECT feature, {r('max(abs(cl - cr))', 'ks_statistic')}, {r('any_value(ml)', 'mean_left')}, {r('any_value(mr)', 'mean_right')} FROM (
  SELECT feature, sum(a) OVER w / sum(a) OVER f AS cl, sum(b) OVER w / sum(b) OVER f AS cr, sum(a * v) OVER f / sum(a) OVER f AS ml,
    sum(b * v) OVER f / sum(b) OVER f AS mr
  FROM (SELECT feature, v, CAST(count(*) FILTER (l) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT l) AS DOUBLE) AS b FROM shift GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY feature ORDER BY v), f AS (PARTITION BY feature)) GROUP BY 1"""))
def ks_shift(spark, sf):
    return X.round_report(H.distribution_shift(read_actions(spark, sf), "alpha", "beta"))


@q("chain_length_stats_l6", with_sql("chains", f"""
SELECT season, count(*) AS n_chains, {r('avg(n_actions)', 'mean_length')}, {r('quantile_cont(n_actions, 0.5)', 'median_length')}
FROM chains GROUP BY 1"""))
def chain_lengths(spark, sf):
    return X.round_report(H.chain_length_stats(C.chain_table(chained(spark, sf))))


# --- priors and weights ------------------------------------------------------------------


@q("class_prior_j4", with_sql(["outcomes", "folds"], f"""
SELECT game_id, {', '.join(r(f'(SELECT avg(CASE WHEN outcome_index = {c} THEN 1e0 ELSE 0 END) FROM outcomes JOIN folds USING (game_id) WHERE fold = $$train$$)', f'p{c}') for c in range(3))}
FROM outcomes"""))
def class_prior(spark, sf):
    from pitchloom.operators import state as ST

    rows = SP.assign_fold(ST.match_outcomes(read_games(spark, sf)), split(spark, sf))
    table = M.predict_prior(rows, rows.where(F.col("fold") == "train"))
    return X.round_report(table.select("game_id", *[F.col("probabilities")[c].alias(f"p{c}") for c in range(3)]))


@q("align_classes_j5", with_sql("scored", f"""
SELECT game_id, window_index, {r('p0', 'p0')}, {r('0', 'p1')}, {r('p2', 'p2')} FROM scored"""))
def align_classes(spark, sf):
    rows = scored_states(spark, sf).withColumn("seen", F.array(F.col("probabilities")[0], F.col("probabilities")[2]))
    aligned = rows.withColumn("a", M.align_classes("seen", [0, 2]))
    return X.round_report(aligned.select("game_id", "window_index", *[F.col("a")[c].alias(f"p{c}") for c in range(3)]))


CTES["window_loss"] = (("rowed",), "SELECT window_index, avg(loss) AS l FROM rowed WHERE model = 'rule' GROUP BY 1")


@q("checkpoint_weights_j15", with_sql("window_loss", f"""
SELECT 'uniform' AS scheme, window_index, 1e0 AS weight FROM window_loss
UNION ALL SELECT 'linear', window_index, {r('(window_index + 1) / 8.5e0', 'weight')} FROM window_loss
UNION ALL SELECT 'b0_signal', window_index, {r('(1 / l) / (SELECT avg(1 / l) FROM window_loss)', 'weight')} FROM window_loss"""))
def checkpoint_weights(spark, sf):
    rule = predictions(spark, sf).where(F.col("model") == "rule")
    loss = K.score(rule, ["window_index"])
    tables = [
        M.checkpoint_weights(spark, scheme, loss).withColumn("scheme", F.lit(scheme))
        for scheme in ("uniform", "linear", "b0_signal")
    ]
    return X.round_report(tables[0].unionByName(tables[1]).unionByName(tables[2]))
