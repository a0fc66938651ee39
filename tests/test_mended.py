"""Faults found in review, each with a small case."""

import pytest
from pyspark.sql import functions as F

from pitchloom.operators import identity, threat
from pitchloom.sources import store


def test_cells_of_missing_coordinates_are_null(spark):
    rows = spark.createDataFrame([(None, 10.0), (float("nan"), 10.0), (10.0, 10.0)], "x double, y double")
    assert [r[0] is None for r in rows.select(threat.cell_of("x", "y")).collect()] == [True, True, False]


def test_names_without_latin_letters_match_nobody(spark):
    left = spark.createDataFrame([(1, "Иван"), (2, "Ana Silva")], "player_id long, player_name string")
    right = spark.createDataFrame([(7, "Пётр"), (8, "Ana Silva")], "player_id long, player_name string")
    found = identity.match_players(left, right).select("player_id_left", "player_id_right").collect()
    assert [tuple(r) for r in found] == [(2, 8)]


def test_unreadable_index_is_kept(spark, tmp_path):
    folder = tmp_path / "index"
    folder.mkdir()
    (folder / "notes.txt").write_text("not parquet")
    fresh = spark.createDataFrame([(1, "p")], "game_id long, provider string")
    with pytest.raises(Exception):
        store.upsert_games(spark, str(folder), fresh)
    assert (folder / "notes.txt").read_text() == "not parquet"
    store.upsert_games(spark, str(tmp_path / "new"), fresh)
    store.upsert_games(spark, str(tmp_path / "new"), fresh.withColumn("game_id", F.lit(2).cast("long")))
    assert [r[0] for r in store.read_games_index(spark, str(tmp_path / "new")).select("game_id").collect()] == [2]


def test_a_store_has_few_files(spark, tmp_path):
    """Rows dealt by partition make one file of each small partition, however many tasks there were."""
    from pitchloom.plans.store_plans import _store

    root = _store(spark, "/root/testdata/sf0.01")
    rows = store.scan_actions(spark, root)
    parts = rows.select("season", "provider").distinct().count()
    assert parts > 1 and len(rows.inputFiles()) == parts and rows.count() == 10_000
