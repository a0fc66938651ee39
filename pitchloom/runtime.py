"""Session helpers: durable lineage cuts and group-size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows one task may be asked to hold for a single group (about 200 bytes a row).
GROUP_ROW_LIMIT = 1_000_000
# Rows per block once an oversized group has been cut into blocks.
BLOCK_ROWS = 250_000


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the one the session names, else a local test one."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    context.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage so that a lost executor cannot change the rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Write a table that several later plans read, once, as parquet in the shared folder.

    Unlike a checkpoint the copy is columnar, so each reader still prunes and filters.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def oversized_groups(df: DataFrame, keys, limit: int = GROUP_ROW_LIMIT) -> DataFrame | None:
    """Keys holding more than ``limit`` rows, or None. One map-side-combined count."""
    found = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    return None if found.isEmpty() else found


def split_by_size(df: DataFrame, keys, limit: int = GROUP_ROW_LIMIT):
    """(rows of bounded groups, rows of oversized groups or None)."""
    big = oversized_groups(df, keys, limit)
    if big is None:
        return df, None
    keys = list(keys)
    return df.join(big, keys, "left_anti"), df.join(big, keys, "left_semi")


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate on every row. The right side is a single row."""
    return df.join(F.broadcast(row), F.lit(True))


def every_pair(blocks: DataFrame) -> DataFrame:
    """Each row of ``blocks`` beside every row, the other's columns with ``_there`` at the end.

    For rows that hold some thousands of records each, after ``durable``. A task keeps the rows of one partition and
    reads all rows, one by one, from the checkpoint: nothing is shuffled or broadcast. Rows
    of a partition meet the others in turn.
    """
    there = blocks.coalesce(1).select(*(F.col(c).alias(f"{c}_there") for c in blocks.columns))
    return there.crossJoin(blocks.hint("shuffle_replicate_nl"))


def blocks_for(spark: SparkSession, rows: int, most: int) -> int:
    """Blocks to cut so many rows into: of at most ``most``, and some for every core."""
    wanted = min(3 * spark.sparkContext.defaultParallelism, -(-rows // 256))
    return max(1, wanted, -(-rows // most))
