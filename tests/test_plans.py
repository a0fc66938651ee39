"""The physical plans that matter at scale."""

import re

import pytest

from pitchloom.plans import registry


def plan(spark, sf, name):
    return registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["infer_recipients_c1", "possessions_c3", "windowed_edges_d5"])
def test_one_shuffle_per_match_stream(spark, sf, name):
    text = plan(spark, sf, name)
    assert len(re.findall("Exchange hash", text)) == 1
    assert "Join" not in text and "ts:timestamp" not in text


def test_ranked_samples_are_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(spark, sf, "stratified_sample_a14")


def test_measures_make_no_table_of_pairs(spark, sf):
    """Betweenness reads nodes and edges once, solves, and joins nothing else."""
    text = plan(spark, sf, "betweenness_e3")
    assert text.count("MapInArrow") == 1 and "Generate" not in text.split("MapInArrow")[0]


def jobs_of(spark, name, work):
    """Jobs that a piece of work starts."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_a_write_is_one_job(spark, sf, tmp_path):
    from pitchloom.sources import store
    from pitchloom.plans.stream_plans import chained
    from pitchloom.runtime import staged

    rows = staged(chained(spark, sf))
    assert jobs_of(spark, "write", lambda: store.write_actions(rows, str(tmp_path / "one"))) == 1
    assert jobs_of(spark, "scan", lambda: store.scan_actions(spark, str(tmp_path / "one"))) == 0


def test_bootstrap_draws_stay_in_their_tasks(spark, sf):
    """No table of draws x matches is exchanged: the draws are added up before the one exchange."""
    from pitchloom.operators import scores
    from pitchloom.plans.score_plans import predictions

    units = predictions(spark, sf).groupBy("model", "game_id").agg({"y": "sum"}).toDF("model", "game_id", "total")
    text = scores._draw_means(units.selectExpr("*", "16L AS n"), ["model"], 50, 1)._jdf.queryExecution().executedPlan().toString()
    above = text[:text.index("Generate explode")]
    assert above.count("Exchange") == 1 and "partial_sum" in above.split("Exchange")[1] and "Join" not in above
