"""Faults of fits and searches found in review, each with a small case."""

import numpy as np
from pyspark.sql import functions as F

from pitchloom import schema as S
from pitchloom.operators import kmeans as KM, models as M, similarity as V


def test_runs_are_not_cut_before_they_settle(spark, monkeypatch):
    monkeypatch.setattr(KM, "STEPS", 1, raising=False)
    x = np.random.default_rng(3).uniform(size=(200, 2))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    fits = KM.fit_runs(df, "v", (6,), starts=1, tolerance=0.0)
    label = ((x[:, None] - fits.centroids[6][None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(fits.centroids[6], [x[label == c].mean(axis=0) for c in range(6)])


def test_exact_neighbours_miss_nobody(spark, monkeypatch):
    monkeypatch.setattr(V, "BUCKET_ROWS", 10)
    monkeypatch.setattr(V, "CHUNK_ROWS", 70)
    x = np.random.default_rng(1).normal(size=(300, 6))
    x[10:20] = x[10]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = np.round(u @ u.T, V.COSINE_DIGITS)
    found = {(r["id"], r["place"]): r["neighbour"]
             for r in V.nearest_all(df, "id", "v", 4, scale=False, exact=True).collect()}
    assert found == {
        (i, place + 1): j for i in range(300) for place, j in enumerate(
            sorted((j for j in range(300) if j != i), key=lambda j: (-cosine[i, j], j))[:4])}


def test_whole_distances_keep_their_digits():
    x = np.random.default_rng(2).normal(1000.0, 1.0, size=(50, 5))
    x[1] = x[0]
    x[2] = x[0] + 1e-6
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(KM._whole_distances(x, x), want, rtol=1e-9, atol=0.0)


def test_learning_curve_is_one_short_plan(spark):
    """Losses of the boosted rung equal those of each fit by itself, and no fitted model is left in the plan."""
    rng = np.random.default_rng(0)
    names = S.FEATURE_LADDER["B2"]
    rows = [(i // 2, "train" if i < 120 else "test", int(rng.integers(0, 3)), [float(v) for v in rng.normal(size=len(names))])
            for i in range(160)]
    states = spark.createDataFrame(rows, "game_id long, fold string, outcome_index int, x array<double>").select(
        "game_id", "fold", "outcome_index", *(F.col("x")[i].alias(n) for i, n in enumerate(names)))
    curve = M.learning_curve(states, (0.5, 1.0), draws=2, rungs=("B0", "B2"), rounds=2)
    plan = curve._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "EvalPython" not in plan and "probabilities" not in plan
    assert sorted((r["model"], r["fraction"], r["draw"], r["n"]) for r in curve.collect()) == sorted(
        (m, f, d, 40) for m in ("B0", "B2") for f, d in ((0.5, 0), (0.5, 1), (1.0, 0)))
    full = curve.where("model = 'B2' AND fraction = 1").first()["log_loss"]
    model = M.fit_boosted(states.where("fold = 'train'"), names, rounds=2)
    alone = M.score(model.predict(states.where("fold = 'test'")).withColumnRenamed("outcome_index", "y")).first()
    assert abs(full - alone["log_loss"]) < 1e-12


def test_role_fits_share_their_passes(spark):
    """Three feature sets cost the jobs of one, and each fit is as good as Spark's own perceptron."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler
    from test_plans import jobs_of

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] > 0) * 2 + (x[:, 1] * x[:, 2] > 0)
    rows = [(i, 1, "s", "p", i % 40, "train" if i % 4 else "test", int(c), *(float(v) for v in row))
            for i, (row, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(
        rows, "game_id long, team_id long, season string, provider string, player_id long, fold string, role_index int, "
        "a double, b double, c double")
    edges = spark.createDataFrame([], "game_id long, team_id long, season string, provider string, source long, target long")
    sets = {"one": ("a",), "two": ("a", "b"), "three": ("a", "b", "c")}
    found = {}
    many = jobs_of(spark, "many", lambda: found.update(
        {(r["feature_set"], r["fold"]): r for r in M.role_ablation(df, edges, sets, hops=0, max_iter=60).collect()}))
    single = jobs_of(spark, "single", lambda: M.role_ablation(df, edges, {"three": sets["three"]}, hops=0, max_iter=60).collect())
    assert many < 1.5 * single
    train = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df.where("fold = 'train'"))
    theirs = MultilayerPerceptronClassifier(featuresCol="f", labelCol="role_index", layers=[3, 32, 4], maxIter=60, seed=0).fit(
        train).transform(train).where("prediction = role_index").count() / 300
    assert found["three", "train"]["n"] == 300 and found["three", "train"]["accuracy"] >= theirs - 0.02
    assert found["one", "train"]["accuracy"] < found["two", "train"]["accuracy"] + 0.05 < found["three", "train"]["accuracy"] + 0.1
    assert found["three", "train"]["accuracy"] > 0.9 and found["three", "test"]["n"] == 100


def test_logistic_fits_of_all_subsets_share_their_passes(spark):
    """Losses equal those of Spark's own model on each subset, at the cost of some thirty jobs in all."""
    from test_plans import jobs_of

    rng = np.random.default_rng(7)
    names = S.FEATURE_LADDER["B0"]
    x = rng.normal(size=(400, len(names))) * 3 + 1
    y = np.argmax(x[:, :1] @ [[0.4, 0.0, -0.4]] + rng.gumbel(size=(400, 3)), axis=1)
    rows = [(i // 2, "train" if i < 300 else "test", int(c), [float(v) for v in row]) for i, (row, c) in enumerate(zip(x, y))]
    states = spark.createDataFrame(rows, "game_id long, fold string, outcome_index int, x array<double>").select(
        "game_id", "fold", "outcome_index", *(F.col("x")[i].alias(n) for i, n in enumerate(names)))
    train, test = (states.where(f"fold = '{fold}'") for fold in ("train", "test"))
    members, subsets = M.match_subsets(train, (0.3, 1.0), 2)
    part = train.join(members, "game_id")
    # The last subset never sees the draw.
    part = M.durable(part.withColumn("subsets", F.concat("subsets", F.array((F.col("outcome_index") != 1).cast("int")))))
    found = {(r["f"], r["n"]): r["log_loss"] for r in M.score(M.fit_logistics(part, names, "subsets").predict_fits(test).select(
        F.col("outcome_index").alias("y"), F.posexplode("fits").alias("f", "probabilities")), ["f"]).collect()}
    for number in range(len(subsets)):
        alone = M.fit_logistic(part.where(F.col("subsets")[number] == 1), names)(test)
        want = M.score(alone.withColumnRenamed("outcome_index", "y")).first()["log_loss"]
        assert abs(found[number, 100] - want) < 1e-6
    assert found[len(subsets), 100] > 5
    assert len(subsets) == 3 and jobs_of(spark, "fits", lambda: M.fit_logistics(part, names, "subsets")) < 30


def test_trees_grown_by_one_task_are_those_of_passes(spark, monkeypatch):
    from pitchloom.operators import boosting as B
    from test_plans import jobs_of

    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(500, 3)), 2)
    y = np.argmax(np.stack([x[:, 0], x[:, 1] * x[:, 0], x[:, 2]], axis=1) + rng.gumbel(size=(500, 3)), axis=1)
    rows = [(*map(float, row), int(c), [1, int(i % 3 > 0), int(c != 2)]) for i, (row, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, outcome_index int, m array<int>")
    fits = {}
    monkeypatch.setattr(B, "BLOCK_ROWS", 130)
    for name, most in (("task", 500), ("passes", 499)):
        monkeypatch.setattr(B, "WHOLE_ROWS", most)
        fits[name, "jobs"] = jobs_of(spark, name, lambda: fits.update(
            {name: B.fit_boosted(df, ("a", "b", "c"), rounds=6, members="m")}))
    one, other = fits["task"], fits["passes"]
    assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and (one.cut < 64).any()
    assert np.allclose(one.value, other.value, atol=1e-12) and (one.value[:, 2, 2] == 0).all()
    assert fits["task", "jobs"] < 15 < fits["passes", "jobs"]


def test_exact_neighbours_move_no_table_twice(spark, monkeypatch):
    """All pairs of blocks meet without a shuffle of copies: what is exchanged holds each vector once."""
    monkeypatch.setattr(V, "PAIR_ROWS", 40)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(330, 5)).astype(np.float32)
    x[200:290] = x[200]
    x[300] = 0
    rows = [(f"k{i:03d}", f"g{i % 4}" if i % 7 else None, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(None, "g0", [1.0] * 5), ("none", "g0", None)]
    df = spark.createDataFrame(rows, "id string, g string, v array<float>")
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-9)
    cosine = np.round(u @ u.T, V.COSINE_DIGITS) + 0.0
    for other in (None, "g"):
        found = V.nearest_all(df, "id", "v", 3, other=other, scale=False, exact=True)
        want = {}
        for i in range(330):
            allowed = [j for j in range(330) if j != i and not (other and rows[i][1] == rows[j][1])]
            want[rows[i][0]] = [rows[j][0] for j in sorted(allowed, key=lambda j: (-cosine[i, j], j))[:3]]
        got = {}
        for r in found.orderBy("id", "place").collect():
            got.setdefault(r["id"], []).append(r["neighbour"])
        assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange hashpartitioning(table" not in plan and "BroadcastNestedLoop" not in plan
