"""Boosted trees against a plain implementation, and shared fits against fits alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchloom.operators import boosting as B


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    raw = np.stack([x[:, 0], 0.8 * x[:, 1] * x[:, 2], -x[:, 0] + 0.3 * rng.normal(size=n)], axis=1)
    y = raw.argmax(axis=1)
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, outcome_index int"), x, y


def plain_boosting(x, y, rounds, cuts, classes=3):
    """Recursive trees, one row at a time where it can be."""
    n = len(x)
    share = np.bincount(y, minlength=classes) / n
    score = np.tile(np.log(share), (n, 1))

    def grow(rows, g, h, depth):
        best = (1e-9, None)
        if depth < 3:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for k in range(x.shape[1]):
                for cut in cuts[k]:
                    left, right = rows[x[rows, k] <= cut], rows[x[rows, k] > cut]
                    if min(len(left), len(right)) < 20 or min(h[left].sum(), h[right].sum()) < 1e-3:
                        continue
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - whole
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, (left, right))
        if best[1] is None:
            return [(rows, -0.06 * g[rows].sum() / (h[rows].sum() + 1))]
        return grow(best[1][0], g, h, depth + 1) + grow(best[1][1], g, h, depth + 1)

    for _ in range(rounds):
        p = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
        for c in range(classes):
            for rows, value in grow(np.arange(n), p[:, c] - (y == c), p[:, c] * (1 - p[:, c]), 0):
                score[rows, c] += value
    return np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)


def test_trees_equal_a_plain_implementation(spark, monkeypatch):
    monkeypatch.setattr(B, "CUT_ROUNDS", 3)
    monkeypatch.setattr(B, "TASK_ROWS", 350)
    df, x, y = table(spark, 900)
    model = B.fit_boosted(df, ["a", "b", "c"], rounds=7)
    want = plain_boosting(x, y, 7, model.edges)
    got = {r["id"]: r["probabilities"] for r in model.predict(df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-9)
    stages = {r["id"]: r["stages"] for r in model.predict_stages(df, (2, 7)).collect()}
    assert np.allclose([stages[i][1] for i in range(len(y))], want, atol=1e-9)
    assert np.allclose([stages[i][0] for i in range(len(y))], plain_boosting(x, y, 2, model.edges), atol=1e-9)


def test_fits_that_share_passes_equal_fits_alone(spark):
    df, _, _ = table(spark, 300, seed=1)
    part = df.withColumn("m", F.array(F.lit(1), (F.col("id") % 3 != 0).cast("int")))
    both = B.fit_boosted(part, ["a", "b", "c"], rounds=4, members="m")
    whole = B.fit_boosted(df, ["a", "b", "c"], rounds=4)
    assert np.allclose(both.value[:, 0], whole.value[:, 0])
    assert not np.allclose(both.value[:, 1], whole.value[:, 0])


def test_unknown_values_and_missing_classes(spark):
    rows = [(i, float(i % 7) if i % 5 else None, float("nan") if i % 4 == 0 else 1.0, 0 if i % 7 < 3 else 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, outcome_index int")
    model = B.fit_boosted(df, ["a", "b"], rounds=3)
    found = model.predict(df).select("probabilities").collect()
    assert all(r[0][1] < 1e-12 and sum(r[0]) == pytest.approx(1.0) for r in found)
    with pytest.raises(ValueError):
        B.fit_boosted(df.where("false"), ["a", "b"])
