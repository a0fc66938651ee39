"""Action store: validated partitioned parquet, match index upsert, inventory, manifest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from pitchloom import schema as S
from pitchloom.functions.hashing import mix
from pitchloom.functions import expressions as X
from pitchloom.operators.ordering import POSITION, dense_position
from pitchloom.runtime import GROUP_ROW_LIMIT, split_by_size


# Where the stream layout keeps its number of buckets; names with an underscore are no data to Spark.
LAYOUT = "_layout"


class StoreError(ValueError):
    """The table is not canonical, or nothing matches the request."""


def _bounds():
    low = -S.BOUNDS_SLACK
    for axis, limit in (("start_x", S.PITCH_LENGTH), ("end_x", S.PITCH_LENGTH),
                        ("start_y", S.PITCH_WIDTH), ("end_y", S.PITCH_WIDTH)):
        yield axis, low, limit + S.BOUNDS_SLACK


def _fault_counts():
    """Aggregates: rows, and how many values break each rule."""
    return [
        F.count(F.lit(1)).alias("rows"),
        X.tally(F.col("period_id").isNull()).alias("null_period"),
        X.tally(F.col("time_seconds") < 0).alias("negative_time"),
        *[
            X.tally((F.col(axis) < low) | (F.col(axis) > high)).alias(f"{axis}_out_of_pitch")
            for axis, low, high in _bounds()
        ],
    ]


def canonical_faults(actions: DataFrame) -> DataFrame:
    """One row: how many values break each rule, in one pass."""
    return actions.agg(*_fault_counts())


def _require_columns(actions: DataFrame, context: str, derived=()) -> None:
    missing = [c for c in S.CANONICAL_COLUMNS if c not in actions.columns and c not in derived]
    if missing:
        raise StoreError(f"{context}: missing columns {missing}")


def _require_sound(faults: dict, context: str) -> None:
    broken = {k: v for k, v in faults.items() if k != "rows" and v}
    if broken:
        raise StoreError(f"{context}: {broken}")


def validate_canonical(actions: DataFrame, context: str = "actions") -> DataFrame:
    """Raise when a column is missing or a value breaks a rule; return the table otherwise."""
    _require_columns(actions, context)
    _require_sound(canonical_faults(actions).first().asDict(), context)
    return actions


# --- folders -----------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """(file system, path object) of a folder on any file system Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename, and raise where the file system only says that it did not."""
    files, path = _files(spark, source)
    if not files.rename(path, _files(spark, target)[1]):
        raise StoreError(f"{source} could not be moved to {target}")


def _remove(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.exists(target)


def by_partition(actions: DataFrame) -> DataFrame:
    """Rows dealt by season and provider, large partitions in several parts: files then number about as many as
    partitions, not tasks times partitions."""
    return actions.hint("rebalance", F.col("season"), F.col("provider"))


def write_actions(actions: DataFrame, root: str) -> None:
    """Validate, then replace only the season/provider partitions that are present.

    One job: the rules are counted while the rows are written beside the store. Rows that break a rule
    are discarded with the error, and the store stays as it was; otherwise each partition takes the
    place of the old one, which is removed last. Every task writes a file for each partition it has rows of;
    ``by_partition`` deals the rows so that these are few.
    """
    _require_columns(actions, "actions")
    spark = actions.sparkSession
    seen = Observation()
    pending = f"{root.rstrip('/')}-pending-{uuid.uuid4().hex}"
    actions.observe(seen, *_fault_counts()).write.partitionBy("season", "provider").parquet(pending)
    try:
        _require_sound(seen.get, "actions")
    except StoreError:
        _remove(spark, pending)
        raise
    files, top = _files(spark, pending)
    parts = [
        f"{season.getPath().getName()}/{provider.getPath().getName()}"
        for season in files.listStatus(top) if season.isDirectory()
        for provider in files.listStatus(season.getPath()) if provider.isDirectory()
    ]
    for part in parts:
        new, old, aside = f"{pending}/{part}", f"{root.rstrip('/')}/{part}", f"{pending}/_old/{part}"
        files.mkdirs(_files(spark, old)[1].getParent())
        if _exists(spark, old):
            files.mkdirs(_files(spark, aside)[1].getParent())
            _move(spark, old, aside)
        try:
            _move(spark, new, old)
        except StoreError:
            if _exists(spark, aside):
                _move(spark, aside, old)
            raise
    _remove(spark, pending)
    spark.catalog.refreshByPath(root)


# --- stream layout -----------------------------------------------------------------------


def write_streams(actions: DataFrame, root: str, buckets: int = 64) -> None:
    """Write actions so that each match lies in one bucket, in its order: operators that go along a match
    then read it where it is. The rules are counted on the write, as in ``write_actions``; recipients
    and possessions may still be missing."""
    _require_columns(actions, "actions", ("recipient_id", "recipient_confident", "possession_id"))
    spark = actions.sparkSession
    seen, name = Observation(), f"streams_{uuid.uuid4().hex}"
    (
        actions.observe(seen, *_fault_counts())
        .repartition(buckets, "game_id").write.format("parquet").option("path", root)
        .bucketBy(buckets, "game_id").sortBy("game_id", *S.ACTION_ORDER).saveAsTable(name)
    )
    spark.sql(f"DROP TABLE {name}")
    try:
        _require_sound(seen.get, "actions")
    except StoreError:
        _remove(spark, root)
        raise
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{root.rstrip('/')}/{LAYOUT}")


def scan_streams(spark: SparkSession, root: str) -> DataFrame:
    """Actions of ``write_streams``, known to be dealt by match."""
    root = root.rstrip("/")
    buckets = spark.read.schema("buckets int").json(f"{root}/{LAYOUT}").first()["buckets"]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(root).schema)
    name = f"streams_{uuid.uuid4().hex}"
    order = ", ".join(("game_id", *S.ACTION_ORDER))
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (game_id) SORTED BY ({order}) "
        f"INTO {buckets} BUCKETS LOCATION '{root}'")
    return spark.table(name)


def scan_actions(
    spark: SparkSession, root: str, season: str | None = None, provider: str | None = None
) -> DataFrame:
    """Read with a fixed schema; the restrictions prune directories."""
    rows = spark.read.schema(S.ACTION_SCHEMA).parquet(root)
    wanted = {column: value for column, value in (("season", season), ("provider", provider)) if value is not None}
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value)
    # The folders alone tell whether a partition is there; no row is read for it.
    if not _partitions(spark, root, wanted):
        raise StoreError(f"no actions for season={season} provider={provider} under {root}")
    return rows


def _partitions(spark: SparkSession, root: str, wanted: dict) -> bool:
    files, top = _files(spark, root)
    pattern = "/".join(f"{column}={wanted.get(column, '*')}" for column in ("season", "provider"))
    return bool(len(files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(top, f"{pattern}/*.parquet")) or []))


def upsert_by_provider(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of rebuilt providers replaced, other providers kept."""
    rebuilt = fresh.select("provider").distinct()
    return existing.join(rebuilt, "provider", "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_games(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Rewrite a match index below ``path``, in which every version has its own folder.

    The new version is written whole; then a pointer to it is put down under the next number, in one
    rename that fails if that number is taken. Until then readers see the old version, after it the
    new one. Versions before the last two are removed at the end.
    """
    path = path.rstrip("/")
    number = _current(spark, path)
    if number is None and _exists(spark, path):
        files, target = _files(spark, path)
        names = [status.getPath().getName() for status in files.listStatus(target)]
        # Versions without a pointer are what a failed first write leaves behind.
        if any(not name.startswith(("version-", "draft-", ".")) for name in names):
            raise StoreError(f"{path} holds files that are no match index")
    rows = fresh if number is None else upsert_by_provider(read_games_index(spark, path), fresh)
    version = f"version-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{version}")
    nxt = 0 if number is None else number + 1
    draft = f"{path}/draft-{version}"
    files, target = _files(spark, draft)
    out = files.create(target)
    out.write(bytearray(version.encode()))
    out.close()
    pointer = f"{path}/current-{nxt:09d}"
    if _exists(spark, pointer):
        raise StoreError(f"another writer has put down {pointer}")
    _move(spark, draft, pointer)
    for old in _pointers(spark, path)[:-2]:
        _remove(spark, f"{path}/{_pointed(spark, path, old)}")
        _remove(spark, f"{path}/current-{old:09d}")


def _pointers(spark: SparkSession, path: str) -> list[int]:
    files, target = _files(spark, path)
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(target, "current-*")) or []
    return sorted(int(status.getPath().getName().removeprefix("current-")) for status in found)


def _current(spark: SparkSession, path: str) -> int | None:
    numbers = _pointers(spark, path)
    return numbers[-1] if numbers else None


def _pointed(spark: SparkSession, path: str, number: int) -> str:
    """The folder name in a pointer file: one short line."""
    return spark.read.text(f"{path}/current-{number:09d}").first()["value"]


def read_games_index(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a match index."""
    path = path.rstrip("/")
    number = _current(spark, path)
    if number is None:
        raise StoreError(f"no match index under {path}")
    return spark.read.parquet(f"{path}/{_pointed(spark, path, number)}")


def inventory(actions: DataFrame) -> DataFrame:
    """Matches, actions and actions per match of each partition."""
    games = F.count_distinct("game_id")
    return actions.groupBy("season", "provider").agg(
        games.alias("games"), F.count(F.lit(1)).alias("actions"),
        (F.count(F.lit(1)) / games).alias("actions_per_game"),
    )


def store_inventory(spark: SparkSession, root: str) -> DataFrame:
    """The inventory plus the megabytes on disk of each partition."""
    rows = spark.read.schema(S.ACTION_SCHEMA).parquet(root)
    sizes = (
        rows.select("season", "provider", "_metadata.file_path", "_metadata.file_size")
        .groupBy("season", "provider", "file_path").agg(F.max("file_size").alias("bytes"))
        .groupBy("season", "provider").agg((F.sum("bytes") / 1e6).alias("size_mb"))
    )
    return inventory(rows).join(sizes, ["season", "provider"])


def canonicalise(raw: DataFrame, games: DataFrame, flip_team: str = "away") -> DataFrame:
    """Names from ids and attack from left to right for both teams.

    ``flip_team`` is the side whose coordinates are mirrored.
    """
    side = games.select("game_id", "home_team_id", "season", "provider")
    joined = raw.join(side, "game_id")
    mirrored = F.col("team_id") != F.col("home_team_id")
    if flip_team == "home":
        mirrored = ~mirrored

    def flip(column, size):
        return F.when(mirrored, F.lit(size) - F.col(column)).otherwise(F.col(column))

    def name(labels, column):
        return F.get(F.array(*[F.lit(x) for x in labels]), F.col(column))

    return joined.withColumns(
        {
            "start_x": flip("start_x", S.PITCH_LENGTH), "end_x": flip("end_x", S.PITCH_LENGTH),
            "start_y": flip("start_y", S.PITCH_WIDTH), "end_y": flip("end_y", S.PITCH_WIDTH),
            "type_name": name(S.ACTION_TYPES, "type_id"),
            "result_name": name(S.RESULT_TYPES, "result_id"),
        }
    ).drop("home_team_id")


def season_action_key(
    actions: DataFrame, limit: int = GROUP_ROW_LIMIT, stride: int = 100_000
) -> DataFrame:
    """Season-unique key: position inside the match plus match id times the stride."""
    bounded, huge = split_by_size(actions, ["game_id"], limit)
    w = Window.partitionBy("game_id").orderBy(*S.ACTION_ORDER)
    out = bounded.withColumn(POSITION, (F.row_number().over(w) - 1).cast("long"))
    if huge is not None:
        out = out.unionByName(dense_position(huge, ["game_id"], S.ACTION_ORDER))
    # A match beyond the stride would share keys with the next one, so it is refused.
    place = F.when(F.col(POSITION) < stride, F.col(POSITION)).otherwise(
        F.raise_error(F.lit(f"a match has more than {stride} actions; raise the stride")).cast("long")
    )
    return out.withColumn("season_action_id", place + F.col("game_id") * stride).drop(POSITION)


def only_available(games: DataFrame, landed: DataFrame) -> DataFrame:
    """Index rows whose events have landed."""
    return games.join(landed.select("game_id").distinct(), "game_id", "left_semi")


# --- samples and exports -----------------------------------------------------------------


def stratified_sample(df: DataFrame, cluster_columns, keys, n: int, seed: int = 0) -> DataFrame:
    """At most n rows per cluster of each cluster column, united. Seeded and order-free.

    The rank filter is applied as a group limit before the shuffle.
    """
    picked = None
    for column in cluster_columns:
        w = Window.partitionBy(column).orderBy(mix(*keys, seed=seed), *keys)
        part = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
        picked = part if picked is None else picked.unionByName(part)
    return picked.distinct() if len(cluster_columns) > 1 else picked


def prefix_sample(rows: DataFrame, n: int) -> DataFrame:
    """All rows of the first n matches of every season."""
    games = rows.select("season", "game_id").distinct()
    w = Window.partitionBy("season").orderBy("game_id")
    first = games.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return rows.join(first, ["season", "game_id"], "left_semi")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of every exported table."""
    out = None
    for name, df in tables.items():
        row = df.agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables whose recorded and found row counts differ, or that exist on one side only."""
    left = expected.select("table_name", F.col("n_rows").alias("expected_rows"))
    right = actual.select("table_name", F.col("n_rows").alias("actual_rows"))
    return left.join(right, "table_name", "full_outer").where(
        ~F.col("expected_rows").eqNullSafe(F.col("actual_rows"))
    )


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Report-sized output as one file: json, csv with header, or parquet."""
    writer = df.coalesce(1).write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "parquet"):
        writer.format(kind).save(path)
    else:
        raise StoreError(f"unknown report kind {kind!r}")
