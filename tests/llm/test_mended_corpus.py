"""Faults of corpus operators found in review, each with a small case."""

import numpy as np

from pitchloom.llm import maxent_lm, pii_bootstrap


def test_counts_go_by_kind_not_by_place(spark):
    texts = [
        "at 10.0.0.1 and 10.0.0.2", "a@b.c 10.0.0.1 a@b.c a@b.c", "4111111111111111, then +1 (017) 555-7713",
        "+1 (017) 555-7713 +1 (017) 555-7714", "nothing", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: tuple(r[f"n_{kind}"] for kind in pii_bootstrap.KINDS)
             for r in pii_bootstrap.report(docs).collect()}
    assert found == {0: (0, 2, 0, 0), 1: (3, 1, 0, 0), 2: (0, 0, 1, 1), 3: (0, 0, 0, 2), 4: (0,) * 4, 5: (0,) * 4}


def test_a_gradient_step_is_the_plain_one():
    """Sums over runs, short and long, and a whole step against plain numpy in double precision."""
    rng = np.random.default_rng(4)
    values = rng.normal(size=(500, 3))
    runs = np.sort(np.concatenate([rng.integers(0, 90, 300), np.full(200, 7)]))
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    source = rng.permutation(500)
    found = maxent_lm._sums(values, source, starts, np.diff(starts, append=500))
    assert np.allclose(found, np.add.reduceat(values[source], starts, axis=0))

    words = maxent_lm.Words([b"%d" % i for i in range(1100)], np.arange(1200, 100, -1))
    ids = rng.integers(0, 1101, 700)
    mine = maxent_lm.Trainer(words, None)
    mine.add(ids)
    mine.flush()
    weights, squares = np.zeros((maxent_lm.ROWS, maxent_lm.MEMBERS)), np.full((maxent_lm.ROWS, maxent_lm.MEMBERS), 1e-2)
    hashes, classes = maxent_lm.contexts(ids, words.begin), np.minimum(ids // 32, 31)
    head = classes < 31
    for rows, bias, wanted in (
        (maxent_lm.class_rows(hashes), words.bias_class[None], classes),
        (maxent_lm.member_rows(hashes[head], classes[head]), words.bias_member[classes[head]], ids[head] % 32),
    ):
        logits = weights[rows].sum(axis=1) + bias
        slope = np.exp(logits - logits.max(axis=1, keepdims=True))
        slope /= slope.sum(axis=1, keepdims=True)
        slope[np.arange(len(wanted)), wanted] -= 1
        total = np.zeros_like(weights)
        np.add.at(total, rows.ravel(), np.repeat(slope, rows.shape[1], axis=0))
        at = np.unique(rows)
        squares[at] += total[at] ** 2
        weights[at] -= maxent_lm.RATE * total[at] / np.sqrt(squares[at])
    assert np.allclose(mine.weights, weights, atol=1e-4)
    scores = maxent_lm.log10_head(words, mine.weights, ids, hashes)
    logits = mine.weights[maxent_lm.class_rows(hashes)].sum(axis=1) + words.bias_class
    chance = np.exp(logits.astype(float)) / np.exp(logits.astype(float)).sum(axis=1, keepdims=True)
    tail = ~head
    assert np.allclose(scores[tail], np.log10(chance[tail, 31]), atol=1e-4)


def test_words_of_the_last_class_have_a_softmax(monkeypatch):
    """After a context all words, those beyond the 31 classes too, add up to one, and the tail learns from it."""
    known = 3_000
    counts = np.arange(known, 0, -1) + 5
    words = maxent_lm.Words([b"%d" % i for i in range(known)], counts, 700.0)
    trainer = maxent_lm.Trainer(words, None)
    rng = np.random.default_rng(2)
    ids = rng.choice(known + 1, 30_000, p=np.append(counts, 700) / (counts.sum() + 700))
    # A frequent word is always followed by the same one of the tail.
    ids[1::2][ids[::2] < 300] = 2_345
    trainer.add(ids)
    trainer.flush()
    every = np.append(np.arange(known), words.rare)
    for last in (5, 1_500, words.rare):
        hashes = np.repeat(maxent_lm.contexts(np.array([9, 8, last, 1]), words.begin)[-1:], len(every), axis=0)
        scores = maxent_lm.log10_head(words, trainer.weights, every, hashes)
        inside = maxent_lm.log10_tail(words, trainer.everything, every, hashes)
        assert (inside[:maxent_lm.HEAD] == 0).all() and (inside[maxent_lm.HEAD:] < 0).all()
        assert abs((10 ** inside[maxent_lm.HEAD:]).sum() - 1) < 1e-4
        assert abs((10 ** (scores + inside)).sum() - 1) < 1e-4
        if last == 5:
            plain = np.log10((counts[2_345] + 1) / ((counts[maxent_lm.HEAD:] + 1).sum() + 700))
            assert inside[2_345] > plain + 0.8
    # Words that no branch tells apart share their leaf by their counts.
    monkeypatch.setattr(maxent_lm, "TAIL_FEATURES", (3,))
    words = maxent_lm.Words([b"%d" % i for i in range(known)], counts, 700.0)
    inside = maxent_lm.log10_tail(words, np.zeros((maxent_lm.ALL_ROWS, 32), np.float32), every, hashes)
    sizes = np.append(counts[maxent_lm.HEAD:] + 1, 700)
    assert np.allclose(inside[maxent_lm.HEAD:], np.log10(sizes / sizes.sum()), atol=1e-4)


def test_vectors_of_a_label_meet_without_a_shuffle_by_cell(spark, monkeypatch):
    """Bundles of a few vectors find the links of brute force, also of double vectors and of several lengths."""
    from pitchloom.llm import subspace_join
    from pitchloom.runtime import durable
    from pyspark.sql import functions as F

    monkeypatch.setattr(subspace_join, "BUNDLE", 9)
    monkeypatch.setattr(subspace_join, "PART", 4)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((20, 12)), 6, axis=0)
    x += 0.04 * rng.standard_normal(x.shape)
    rows = [(i, (v if i % 5 else v[:7]).tolist(), i % 3) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    links = [sum(j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98
                 for j in range(len(rows))) for i in range(len(rows))]
    assert {r["vec_id"]: r["n_links"] for r in subspace_join.near_vectors(table).collect()} == dict(enumerate(links))
    assert max(links) > 0
    distinct = table.withColumn("node", F.col("vec_id")).withColumn("copies", F.lit(1))
    found = subspace_join.verified(durable(subspace_join.bundles(distinct, 5)), 0.98)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
