"""K-means runs and silhouettes against plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.operators import kmeans as KM


def points(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.4, size=(n // 3, 3)) for c in (0.0, 3.0, -4.0)])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>"), x


def test_runs_end_at_their_means(spark, monkeypatch):
    monkeypatch.setattr(KM, "TASK_ROWS", 70)
    df, x = points(spark)
    fits = KM.fit_runs(df, "v", (2, 3, 5), starts=4, tolerance=0.0)
    for place, k in enumerate((2, 3, 5)):
        own = {r["id"]: r["clusters"][place] for r in fits.assign(df, "v").collect()}
        label = np.array([own[i] for i in range(len(x))])
        apart = ((x[:, None] - fits.centroids[k][None]) ** 2).sum(axis=2)
        assert (apart[np.arange(len(x)), label] <= apart.min(axis=1) + 1e-9).all()
        assert np.allclose(fits.centroids[k], [x[label == c].mean(axis=0) for c in range(k)])
        assert fits.cost[k] == pytest.approx(apart.min(axis=1).sum())
    # Three clouds: the three clusters are the clouds.
    assert fits.cost[3] < 0.2 * fits.cost[2]


def plain_silhouette(x, label):
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        mine = label == label[i]
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = apart[i, mine].sum() / (mine.sum() - 1)
        b = min(apart[i, label == c].mean() for c in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouettes_are_exact_over_blocks(spark, monkeypatch):
    df, x = points(spark, 120, seed=2)
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3, 120), rng.integers(0, 4, 120)
    a[0] = 3
    rows = [(i, [float(v) for v in x[i]], [int(a[i]), int(b[i])]) for i in range(120)]
    table = spark.createDataFrame(rows, "id long, v array<double>, l array<int>")
    want = [plain_silhouette(x, a), plain_silhouette(x, b)]
    for size in (1000, 32):
        monkeypatch.setattr(KM, "BLOCK_ROWS", size)
        got = {r["place"]: r["silhouette"] for r in KM.silhouettes(table, "v", "l", [4, 4]).collect()}
        assert [got[0], got[1]] == pytest.approx(want, abs=1e-9)


def test_few_and_equal_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "id long, v array<double>")
    fits = KM.fit_runs(df, "v", (4,), starts=2)
    assert fits.cost[4] == 0.0 and len(fits.centroids[4]) == 4
    with pytest.raises(ValueError):
        KM.fit_runs(df.where("false"), "v", (2,))


def test_neighbours_of_every_row(spark, monkeypatch):
    """All rows of one bucket are exact; many buckets find nine in ten at least."""
    from pitchloom.operators import similarity as V

    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)) + 2 * rng.normal(size=(30, 8))[rng.integers(0, 30, 900)]
    x[5] = x[6] = x[7]
    rows = [(i, f"g{i % 3}", [float(v) for v in x[i]]) for i in range(900)] + [(900, "g0", None), (901, "g1", [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    u = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((2, 8))])
    cosine = np.round(u @ u.T, V.COSINE_DIGITS)
    group = np.array([r[1] for r in rows])

    def want(other):
        out = {}
        for i in range(len(u)):
            allowed = [j for j in range(len(u)) if j != i and (not other or group[i] != group[j])]
            out[i] = sorted(allowed, key=lambda j: (-cosine[i, j], j))[:4]
        return out

    def found(**options):
        out = {}
        for r in V.nearest_all(df, "id", "v", 4, scale=False, **options).orderBy("id", "place").collect():
            out.setdefault(r["id"], []).append(r["neighbour"])
        return out

    monkeypatch.setattr(V, "BUCKET_ROWS", 1000)
    monkeypatch.setattr(V, "CHUNK_ROWS", 300)
    df = df.na.drop(subset=["v"]).unionByName(df.where("v IS NULL").selectExpr("id", "g", "array_repeat(0D, 8) AS v"))
    assert found() == want(False) and found(other="g") == want(True)
    monkeypatch.setattr(V, "BUCKET_ROWS", 60)
    got, exact = found(), want(False)
    assert np.mean([len(set(got[i]) & set(exact[i])) / 4 for i in range(900)]) >= 0.9


def test_silhouettes_exchange_no_sums_of_rows(spark, monkeypatch):
    """Blocks meet without a shuffle of copies, and what a task leaves does not grow with its rows."""
    monkeypatch.setattr(KM, "BLOCK_ROWS", 20)
    df, x = points(spark, 90, seed=6)
    table = KM.fit_runs(df, "v", (2, 3), starts=1).assign(df, "v").drop("id")
    found = KM.silhouettes(table, "v", "clusters", [2, 3])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange hashpartitioning(block" not in plan and "id" not in found.columns
    label = np.array([r["clusters"] for r in table.select("v", "clusters").collect()])
    rows = np.array([r["v"] for r in table.select("v", "clusters").collect()])
    got = {r["place"]: r["silhouette"] for r in found.collect()}
    assert [got[0], got[1]] == pytest.approx([plain_silhouette(rows, label[:, k]) for k in (0, 1)], abs=1e-9)
    single = KM.silhouettes(table.withColumn("clusters", F.array(F.lit(0))), "v", "clusters", [3])
    assert [tuple(r) for r in single.collect()] == [(0, None)]


def test_a_pass_uses_every_core(spark):
    """Some ten thousand rows are a task, so the last pass over 30,000 is not one task's work."""
    rows = spark.range(30_000).select(F.array(F.rand(1), F.rand(2)).alias("v"))
    spark.sparkContext.setJobGroup("pass", "pass")
    try:
        KM.fit_runs(rows, "v", (2,), starts=1, tolerance=1.0)
        tracker = spark.sparkContext.statusTracker()
        last = tracker.getJobInfo(max(tracker.getJobIdsForGroup("pass")))
        assert max(tracker.getStageInfo(stage).numTasks for stage in last.stageIds) == 3
    finally:
        spark.sparkContext.setJobGroup("", "")
