"""MLlib pipelines: outcome ladder, role models, clustering sweeps, embeddings.

Fits are always made on the training fold only, and scaling uses population moments.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from pitchloom import schema as S
from pitchloom.functions.hashing import mix
from pitchloom.operators.boosting import Ensemble, fit_boosted
from pitchloom.operators.features import neighbour_means
from pitchloom.operators.kmeans import STARTS, TOLERANCE, fit_clusterings, silhouettes
from pitchloom.operators.logistic import fit_logistics
from pitchloom.operators.ordering import POSITION, global_position
from pitchloom.operators.perceptron import fit_perceptrons
from pitchloom.operators.scores import agreement, score, shot_lift
from pitchloom.operators.similarity import standardise
from pitchloom.operators.splits import LeakageError, assert_no_enrichment
from pitchloom.runtime import attach_row, durable, staged

K_VALUES = (4, 6, 8, 10, 12)
ROUND_GRID = (25, 50, 100, 200)
CLASSES = len(S.OUTCOMES)
# Rows of a k sweep between which silhouettes are measured.
SILHOUETTE_ROWS = 8_000


def feature_array(names) -> Column:
    listed = ", ".join(f"CAST({n} AS double)" for n in names)
    return F.expr(f"array({listed})")


def scaled_features(df: DataFrame, train: DataFrame, names, out: str = "features") -> DataFrame:
    """Add the standardised feature vector, with moments of the training rows."""
    raw = df.withColumn("_raw", feature_array(names))
    fitted = standardise(raw, "_raw", "_scaled", fit_on=train.withColumn("_raw", feature_array(names)))
    return fitted.withColumn(out, array_to_vector("_scaled")).drop("_raw", "_scaled")


# --- priors, alignment, weights ----------------------------------------------------------


def class_prior(train: DataFrame, label: str = "outcome_index", classes: int = CLASSES) -> DataFrame:
    """One row: training frequency of each class as an array."""
    n = F.count(F.lit(1))
    return train.agg(
        F.array(*[F.count_if(F.col(label) == c) / F.nullif(n, F.lit(0)) for c in range(classes)]).alias("probabilities")
    )


def predict_prior(df: DataFrame, train: DataFrame, label: str = "outcome_index") -> DataFrame:
    return attach_row(df, class_prior(train, label))


def align_classes(column: str, present, classes: int = CLASSES) -> Column:
    """Fixed class layout: a class the model never saw has probability 0."""
    slots = [
        f"coalesce(get({column}, {list(present).index(c)}), 0D)" if c in present else "0D"
        for c in range(classes)
    ]
    return F.expr(f"array({', '.join(slots)})")


def checkpoint_weights(spark, scheme: str = "uniform", b0_loss: DataFrame | None = None) -> DataFrame:
    """(window_index, weight) with mean 1: uniform, linear in time, or inverse to B0's loss."""
    if scheme == "uniform":
        raw = spark.range(S.WINDOW_COUNT).select(F.col("id").alias("window_index"), F.lit(1.0).alias("_w"))
    elif scheme == "linear":
        raw = spark.range(S.WINDOW_COUNT).select(
            F.col("id").alias("window_index"), (F.col("id") + 1).cast("double").alias("_w")
        )
    elif scheme == "b0_signal":
        if b0_loss is None:
            raise ValueError("scheme b0_signal needs the training log-loss per checkpoint")
        seen = b0_loss.count()
        if seen != S.WINDOW_COUNT:
            raise ValueError(f"expected {S.WINDOW_COUNT} checkpoint losses, got {seen}")
        raw = b0_loss.select("window_index", (1.0 / F.greatest(F.col("log_loss"), F.lit(1e-6))).alias("_w"))
    else:
        raise ValueError(f"unknown weight scheme {scheme!r}")
    return attach_row(raw, raw.agg(F.avg("_w").alias("_mean"))).select(
        "window_index", (F.col("_w") / F.col("_mean")).alias("weight")
    )


# --- outcome ladder ----------------------------------------------------------------------


def fit_logistic(
    train: DataFrame, names, label: str = "outcome_index", classes: int = CLASSES,
    strength: float = 1.0, weight: str | None = None, max_iter: int = 200,
):
    """Multinomial logistic model; returns a function adding a probability array."""
    prepared = durable(scaled_features(train, train, names))
    rows = prepared.count()
    model = LogisticRegression(
        featuresCol="features", labelCol=label, family="multinomial", maxIter=max_iter,
        regParam=1.0 / (strength * max(rows, 1)), elasticNetParam=0.0, standardization=False, tol=1e-10,
        probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred",
        **({"weightCol": weight} if weight else {}),
    ).fit(prepared)
    present = list(range(model.numClasses))
    moments_from = train
    weights, penalty = model.coefficientMatrix.toArray(), 1.0 / (strength * max(rows, 1))

    def predict(df: DataFrame, out: str = "probabilities") -> DataFrame:
        scored = model.transform(scaled_features(df, moments_from, names))
        return scored.withColumn("_a", vector_to_array("_prob")).withColumn(
            out, align_classes("_a", present, classes)
        ).drop("features", "_prob", "_raw", "_pred", "_a")

    def slopes() -> DataFrame:
        """(class, feature, n, slope): derivative of the mean penalised loss by each weight and, with a null
        feature, by each intercept, on the training rows. All are 0 at the optimum."""
        scored = model.transform(prepared).select(
            F.col(label).alias("_y"), vector_to_array("_prob").alias("_p"), vector_to_array("features").alias("_x"))
        cells = [(c, k) for c in present for k in range(-1, len(names))]
        off = {c: F.col("_p")[c] - F.when(F.col("_y") == c, 1.0).otherwise(0.0) for c in present}
        row = scored.agg(F.count(F.lit(1)).alias("n"), *(
            F.avg(off[c] * (F.col("_x")[k] if k >= 0 else F.lit(1.0))).alias(f"s{c}_{k + 1}") for c, k in cells))
        return row.select("n", F.explode(F.array(*(
            F.struct(
                F.lit(c).alias("class"), F.lit(names[k] if k >= 0 else None).cast("string").alias("feature"),
                (F.col(f"s{c}_{k + 1}") + (penalty * float(weights[c][k]) if k >= 0 else 0.0)).alias("slope"))
            for c, k in cells))).alias("_s")).select("_s.*", "n")

    predict.slopes = slopes
    return predict


def _as_predictions(df: DataFrame, model: str, label: str = "outcome_index") -> DataFrame:
    keep = [c for c in ("game_id", "season", "window_index", "checkpoint_minute", "fold") if c in df.columns]
    return df.select(*keep, F.col(label).alias("y"), "probabilities", F.lit(model).alias("model"))


def capacity_trace(model: Ensemble, val: DataFrame, grid=ROUND_GRID, label: str = "outcome_index") -> DataFrame:
    """(rounds, n, log_loss) on validation rows after each number of rounds: prefixes of one fit."""
    grid = sorted(grid)
    staged_rows = model.predict_stages(val, grid).select(
        F.col(label).alias("y"), F.posexplode("stages").alias("_place", "probabilities"))
    rounds = F.element_at(F.array(*map(F.lit, grid)), F.col("_place") + 1)
    return score(staged_rows.withColumn("rounds", rounds), ["rounds"]).select("rounds", "n", "log_loss")


def select_rounds(train: DataFrame, val: DataFrame, names, grid=ROUND_GRID) -> tuple[int, Ensemble, DataFrame]:
    """(rounds, fit, trace): the rounds with the lowest log-loss on the match-disjoint validation fold, the
    fewest on a tie."""
    model = fit_boosted(train, names, rounds=max(grid))
    trace = durable(capacity_trace(model, val, grid))
    best = trace.orderBy("log_loss", "rounds").first()
    if best is None:
        raise ValueError("the validation fold is empty; capacity cannot be chosen")
    return best["rounds"], model, trace


def fit_ladder(states: DataFrame, rungs=("prior", "B0", "B1", "B2"), grid=ROUND_GRID) -> DataFrame:
    """Long prediction table of every rung over all used folds of a fold-labelled state table."""
    states = durable(states.where(F.col("fold") != "unused"))
    train = states.where(F.col("fold") == "train")
    out = None
    for rung in rungs:
        names = S.FEATURE_LADDER.get(rung)
        if rung == "prior":
            predicted = predict_prior(states, train)
        elif rung == "B2":
            rounds, model, _ = select_rounds(train, states.where(F.col("fold") == "val"), names, grid)
            predicted = model.predict(states, rounds=rounds)
        else:
            predicted = fit_logistic(train, names)(states)
        rows = _as_predictions(predicted, rung)
        out = rows if out is None else out.unionByName(rows)
    return out


def permutation_importance(
    train: DataFrame, names=S.B2_FEATURES, repeats: int = 5, seed: int = 0, label: str = "outcome_index",
    predict=None,
) -> DataFrame:
    """Mean and spread of the log-loss rise when one feature of the boosted rung is shuffled.

    A shuffle gives each row the value at another place of a seeded hash order; the orders of all repeats
    stand beside each other, and all shuffles of a feature set are scored in one long table.
    ``predict`` adds probabilities to rows with the features (default: boosted trees on ``train``).
    """
    names = list(names)
    predict = predict or fit_boosted(train, names, label).predict
    rows = durable(
        global_position(train.withColumn("_id", F.col("game_id") * 100 + F.col("window_index")), ["_id"])
        .select(F.col(POSITION).alias("_at"), "_id", F.col(label).alias("y"), *names)
    )
    # (repeat, place in the shuffled order, values): one sort of row ids for each repeat.
    orders = None
    for repeat in range(repeats):
        order = mix("_id", seed=seed + 7919 * (repeat + 1))
        one = global_position(rows.select("_id", order.alias("_h"), F.struct(*names).alias("_other")), ["_h", "_id"])
        one = one.select(F.lit(repeat).alias("repeat"), F.col(POSITION).alias("_at"), "_other")
        orders = one if orders is None else orders.unionByName(one)
    swapped = F.explode(F.array(*(
        F.struct(F.lit(name).alias("feature"), *(
            (F.col(f"_other.{c}") if c == name else F.col(c)).cast("double").alias(c) for c in names))
        for name in names)))
    moved = rows.join(orders, "_at").select("repeat", "y", swapped.alias("_s")).select("repeat", "y", "_s.*")
    losses = score(predict(moved), ["feature", "repeat"])
    base = score(predict(rows)).select(F.col("log_loss").alias("_base"))
    return attach_row(losses, base).groupBy("feature").agg(
        F.avg(F.col("log_loss") - F.col("_base")).alias("importance_mean"),
        F.stddev_pop(F.col("log_loss") - F.col("_base")).alias("importance_std"),
    )


# --- learning curve and pooling ----------------------------------------------------------


def match_subsets(train: DataFrame, fractions, draws: int, seed: int = 0, least: int = 20) -> DataFrame:
    """(game_id, subsets): for each match the numbers of the subsets it is in, and the list of subsets.

    Returns (matches with an array ``subsets`` of 0/1 by subset, [(fraction, draw, matches)]). A subset of a
    fraction holds the matches that come first in its own hash order, never fewer than ``least`` if
    there are that many; the whole set is drawn once.
    """
    games = durable(train.select("game_id").distinct())
    size = games.count()
    subsets = []
    for fraction in fractions:
        wanted = min(max(int(fraction * size + 0.5), least), size)
        subsets += [(float(fraction), draw, wanted) for draw in range(draws if wanted < size else 1)]
    placed = games
    for draw in sorted({draw for _, draw, _ in subsets}):
        ordered = games.withColumn("_h", mix("game_id", seed=seed + 101 * draw))
        placed = placed.join(
            global_position(ordered, ["_h", "game_id"]).select("game_id", F.col(POSITION).alias(f"_at{draw}")), "game_id")
    member = F.array(*((F.col(f"_at{draw}") < wanted).cast("int") for _, draw, wanted in subsets))
    return placed.select("game_id", member.alias("subsets")), subsets


def learning_curve(
    states: DataFrame, fractions=(0.1, 0.25, 0.5, 0.75, 1.0), draws: int = 3, rungs=("B0", "B1", "B2"),
    least: int = 20, seed: int = 0, rounds: int = ROUND_GRID[-1], test_column: str | None = None,
) -> DataFrame:
    """Test log-loss of refits on growing random subsets of training matches.

    Each rung fits all subsets together. With ``test_column`` each of its values is a
    test fold of its own.
    """
    states = durable(states)
    train, test = states.where("fold = 'train'"), states.where("fold = 'test'")
    test = durable(test.withColumn("test_fold", F.col(test_column) if test_column else F.lit("test")))
    members, subsets = match_subsets(train, fractions, draws, seed, least)
    part = durable(train.join(members, "game_id"))
    table = part.sparkSession.createDataFrame(
        [(number, *subset) for number, subset in enumerate(subsets)],
        "subset int, fraction double, draw int, n_matches long")
    out = None
    for rung in rungs:
        names = S.FEATURE_LADDER[rung]
        model = fit_boosted(part, names, rounds=rounds, members="subsets") if rung == "B2" else fit_logistics(
            part, names, "subsets")
        rows = model.predict_fits(test).select(
            "test_fold", F.col("outcome_index").alias("y"), F.posexplode("fits").alias("subset", "probabilities"))
        # Written out, so the fitted models do not pile up in one plan.
        losses = staged(score(rows, ["subset", "test_fold"])).join(table, "subset").select(
            F.lit(rung).alias("model"), "test_fold", "fraction", "draw", "n_matches", "n", "log_loss")
        out = losses if out is None else out.unionByName(losses)
    return out


def curve_verdict(curve: DataFrame) -> DataFrame:
    """Gain from half to all matches against the spread between subsets."""
    keys = [c for c in ("model", "test_fold") if c in curve.columns]
    per = curve.groupBy(*keys, "fraction").agg(
        F.avg("log_loss").alias("mean_loss"), F.stddev_samp("log_loss").alias("noise")
    )
    return per.groupBy(*keys).agg(
        F.min_by("mean_loss", F.abs(F.col("fraction") - 0.5)).alias("half_loss"),
        F.max_by("mean_loss", "fraction").alias("full_loss"), F.max("noise").alias("noise"),
    ).withColumn("gain", F.col("half_loss") - F.col("full_loss")).withColumn(
        "plateau", F.col("gain") <= F.coalesce("noise", F.lit(0.0))
    )


def pooled_fits(states: DataFrame, corpus: str, names=S.B1_FEATURES):
    """(test rows of one corpus, its own fit, the pooled fit); a test match in the pooled training rows
    raises LeakageError."""
    states = durable(states)
    test = states.where((F.col("corpus") == corpus) & (F.col("fold") == "test"))
    pooled = states.where(F.col("fold") == "train")
    if not pooled.join(test.select("game_id").distinct(), "game_id", "left_semi").isEmpty():
        raise LeakageError("a test match is part of the pooled training rows")
    return test, fit_logistic(pooled.where(F.col("corpus") == corpus), names), fit_logistic(pooled, names)


def pooled_vs_single(states: DataFrame, corpus: str, names=S.B1_FEATURES) -> DataFrame:
    """Predictions on one corpus's test fold from its own and from the pooled training rows."""
    test, own, everyone = pooled_fits(states, corpus, names)
    return _as_predictions(own(test), "single").unionByName(_as_predictions(everyone(test), "pooled"))


def pool_corpora(tables: dict[str, DataFrame]) -> DataFrame:
    """State tables of several corpora with a corpus tag."""
    out = None
    for name, table in tables.items():
        tagged = table.withColumn("corpus", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


# --- roles -------------------------------------------------------------------------------


def role_ablation(
    features: DataFrame, edges: DataFrame, sets=None, label: str = "role_index", hops: int = 2,
    hidden: int = 32, max_iter: int = 200, seed: int = 0,
) -> DataFrame:
    """Four-class role accuracy per feature set and fold, on fold-labelled node features.

    Features are carried over the lanes first: a player's own values stand beside the means of those
    who pass to them, one and two hops back; a perceptron with one hidden layer reads all of them.
    """
    features = durable(features.where(F.col("fold") != "unused"))
    sets = sets or S.FEATURE_SETS
    on = [*S.NETWORK_KEYS, "player_id"]
    every = sorted({name for columns in sets.values() for name in columns})
    assert_no_enrichment(features.select(*every), "role features")
    # One propagation serves all sets, and so do the passes of their fits.
    carried = durable(features.select(*on, "fold", label).join(
        neighbour_means(features, edges, every, hops=hops), on))
    wide = [[*columns, *(f"{c}_hop{hop}" for hop in range(1, hops + 1) for c in columns)] for columns in sets.values()]
    model = fit_perceptrons(
        carried.where(F.col("fold") == "train"), wide, label, len(S.COARSE_ROLES), hidden, max_iter, seed)
    rows = model.predict_fits(carried).select(
        "fold", F.col(label).alias("y"), F.posexplode("fits").alias("_set", "probabilities"))
    name = F.element_at(F.array(*map(F.lit, sets)), F.col("_set") + 1)
    return score(rows, ["_set", "fold"]).select(name.alias("feature_set"), "fold", "n", "accuracy", "log_loss")


# --- clustering --------------------------------------------------------------------------


def fit_clusters(df: DataFrame, column: str, k: int, seed: int = 0, starts: int = STARTS,
                 train: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """K-means fitted on training rows, best of several starts, every row assigned to ``cluster``."""
    labelled, _ = fit_clusterings(df, column, (k,), seed, starts, train, tolerance)
    return labelled.withColumn("cluster", F.col("clusters")[0]).drop("clusters")


def cluster_and_score(
    df: DataFrame, column: str, coarse: str, fine: str | None = None, k_values=K_VALUES,
    seed: int = 0, starts: int = STARTS, representation: str = "",
) -> DataFrame:
    """Agreement with coarse and fine labels and exact silhouette for each k; all k share their passes."""
    k_values = sorted(k_values)
    labelled, _ = fit_clusterings(df, column, k_values, seed, starts)
    labelled = staged(labelled)
    # ``place`` is a clustering's position among the rising k.
    apart = silhouettes(labelled, "scaled", "clusters", k_values)
    out = None
    for place, k in enumerate(k_values):
        rows = labelled.withColumn("cluster", F.col("clusters")[place])
        row = agreement(rows, coarse, "cluster").select(
            F.lit(representation).alias("representation"), F.lit(k).alias("k"), F.lit(place).alias("place"),
            F.col("adjusted_rand").alias("ari_coarse"), F.col("nmi").alias("nmi_coarse"),
        )
        if fine is not None:
            row = attach_row(
                row, agreement(rows, fine, "cluster").select(
                    F.col("adjusted_rand").alias("ari_fine"), F.col("nmi").alias("nmi_fine")
                ),
            )
        out = row if out is None else out.unionByName(row)
    return out.join(apart, "place", "left").drop("place")


def sweep_k(
    chains: DataFrame, column: str, k_values=K_VALUES, seed: int = 0, starts: int = STARTS,
    representation: str = "", sample: int = SILHOUETTE_ROWS,
) -> DataFrame:
    """Silhouette and shot discrimination per k on fold-labelled chains; all k share their passes.

    The silhouette looks at up to ``sample`` rows, chosen by a hash of the vector, with whole distances
    between them; it uses moments of all rows, as every representation is judged on its own scale.
    """
    k_values = sorted(k_values)
    labelled, _ = fit_clusterings(
        chains, column, k_values, seed, starts, chains.where(F.col("fold") == "train"))
    labelled = staged(standardise(labelled, column, "_whole"))
    some = labelled.orderBy(F.xxhash64("_whole", F.lit(seed))).limit(sample)
    apart = silhouettes(some, "_whole", "clusters", k_values)
    flat = labelled.where(F.col("fold").isin("train", "test")).select(
        "fold", "ends_in_shot", F.posexplode("clusters").alias("place", "cluster"))
    lift = shot_lift(flat, ["place", "fold"])

    def when(fold, c):
        return F.when(F.col("fold") == fold, F.col(c))

    table = lift.groupBy("place").agg(
        (F.max(when("train", "shot_rate")) - F.min(when("train", "shot_rate"))).alias("shot_rate_spread_train"),
        (F.max(when("test", "shot_rate")) - F.min(when("test", "shot_rate"))).alias("shot_rate_spread_test"),
        F.max(when("test", "lift")).alias("max_lift_test"),
        F.count_if((F.col("fold") == "test") & F.col("differs_from_base")).alias("clusters_differing_test"),
        *(F.sum(when(fold, "n_chains")).alias(f"n_{fold}") for fold in ("train", "test")),
        *(F.max(when(fold, "base_rate")).alias(f"base_rate_{fold}") for fold in ("train", "test")),
    )
    return table.join(apart, "place", "left").select(
        F.lit(representation).alias("representation"),
        F.element_at(F.array(*map(F.lit, k_values)), F.col("place") + 1).alias("k"), "silhouette",
        "shot_rate_spread_train", "shot_rate_spread_test", "max_lift_test", "clusters_differing_test",
        "n_train", "n_test", "base_rate_train", "base_rate_test",
    )


def components_of(rows: DataFrame, column: str, k: int, out: str) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with their place on the first k principal components, the components).

    Components are (component, weights, share): unit vectors in the order of the share of all variance that
    lies on them; their signs are arbitrary.
    """
    model = PCA(k=k, inputCol="_v", outputCol="_e").fit(rows.select(array_to_vector(F.col(column)).alias("_v")))
    axes = model.pc.toArray()
    parts = rows.sparkSession.createDataFrame(
        [(i, [float(w) for w in axes[:, i]], float(model.explainedVariance[i])) for i in range(k)],
        "component int, weights array<double>, share double")
    placed = model.transform(rows.withColumn("_v", array_to_vector(F.col(column))))
    return placed.withColumn(out, vector_to_array("_e")).drop("_v", "_e"), parts


def sequence_embedding(sequences: DataFrame, k: int = 32, column: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Fixed-length chain vector ``embedding``: principal components of the flat padded tokens, and those."""
    rows = sequences.withColumn("_t", F.expr(f"transform({column}, v -> CAST(v AS double))"))
    placed, parts = components_of(rows, "_t", k, "embedding")
    return placed.drop("_t"), parts


def projection(df: DataFrame, column: str, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """Standardised vectors on their first principal components (``projection``), and those."""
    placed, parts = components_of(standardise(df, column, "_s"), "_s", k, "projection")
    return placed.drop("_s"), parts
