"""Vector similarity: standardising, player consistency, stability, nearest centroids.

Mean cosines over pairs come from sums of unit vectors: the mean over all pairs of a group is
(|sum|^2 - n) / (n (n - 1)). No pair is ever built, and no row is sampled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from pitchloom.runtime import attach_row, blocks_for, durable, every_pair, staged

SMALL_NORM = 1e-9
SMALL_SPREAD = 1e-6


def clean_vector(column: str) -> Column:
    """Doubles with unknown values as zero."""
    return F.expr(f"transform({column}, v -> coalesce(nanvl(CAST(v AS double), 0D), 0D))")


def vector_moments(df: DataFrame, column: str) -> DataFrame:
    """One row: per-dimension mean and population deviation (below 1e-6 becomes 1)."""
    stats = df.select(array_to_vector(clean_vector(column)).alias("_v")).agg(
        Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("_s")
    )
    mean, variance = vector_to_array("_s.mean"), vector_to_array("_s.variance")
    return stats.select(
        mean.alias("_mean"),
        F.transform(
            variance,
            lambda v: F.when(
                F.sqrt(v * (F.col("_s.count") - 1) / F.col("_s.count")) < SMALL_SPREAD, 1.0
            ).otherwise(F.sqrt(v * (F.col("_s.count") - 1) / F.col("_s.count"))),
        ).alias("_sd"),
    )


def standardise(df: DataFrame, column: str, out: str = "scaled", fit_on: DataFrame | None = None) -> DataFrame:
    """Scale every row with moments of ``fit_on`` (the training rows), or of all rows."""
    moments = vector_moments(df if fit_on is None else fit_on, column)
    scaled = F.expr(
        f"transform(arrays_zip(_x, _mean, _sd), t -> (t._x - t._mean) / t._sd)"
    )
    return (
        attach_row(df.withColumn("_x", clean_vector(column)), moments)
        .withColumn(out, scaled).drop("_x", "_mean", "_sd")
    )


def unit(column: str) -> Column:
    norm = f"sqrt(aggregate({column}, 0D, (a, v) -> a + v * v))"
    return F.expr(f"transform({column}, v -> v / IF({norm} < {SMALL_NORM}D, 1D, {norm}))")


def dot(left: str, right: str) -> Column:
    return F.expr(f"aggregate(zip_with({left}, {right}, (a, b) -> a * b), 0D, (s, v) -> s + v)")


def sum_vectors(df: DataFrame, keys, column: str, out: str) -> DataFrame:
    """Element-wise sum of array columns with a vector aggregate (partial sums map-side)."""
    return df.groupBy(*keys).agg(
        Summarizer.sum(array_to_vector(F.col(column))).alias("_v"), F.count(F.lit(1)).alias("n")
    ).select(*keys, vector_to_array("_v").alias(out), "n")


def mean_vectors(df: DataFrame, keys, column: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col(column))).alias("_v"), F.count(F.lit(1)).alias("n")
    ).select(*keys, vector_to_array("_v").alias(out), "n")


def within_entity_consistency(df: DataFrame, entity: str, column: str) -> DataFrame:
    """Mean same-entity cosine against the mean cosine to everybody else.

    Exact over all pairs; each entity with two or more rows counts once.
    """
    rows = standardise(df, column).withColumn("_u", unit("scaled"))
    own = sum_vectors(rows, [entity], "_u", "_own")
    everyone = sum_vectors(rows, [], "_u", "_all").withColumnRenamed("n", "_total")
    table = attach_row(own.where(F.col("n") >= 2), everyone)
    n, total = F.col("n"), F.col("_total")
    # A zero vector has a zero unit vector, so its pairs count as zero cosine.
    self_dots = sum_self = dot("_own", "_own")
    units = rows.groupBy(entity).agg(F.sum(dot("_u", "_u")).alias("_norms"))
    table = table.join(units, entity)
    same = (self_dots - F.col("_norms")) / (n * (n - 1))
    other = (dot("_own", "_all") - sum_self) / F.nullif((n * (total - n)).cast("double"), F.lit(0.0))
    return table.agg(
        F.count(F.lit(1)).alias("n_players"), F.avg(same).alias("same_player_cosine"),
        F.avg(other).alias("diff_player_cosine"),
    ).withColumn("lift", F.col("same_player_cosine") - F.col("diff_player_cosine"))


def matched_similarity(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Mean cosine of matched vectors and its expectation under a random re-pairing."""
    units = pairs.select(unit(left).alias("_l"), unit(right).alias("_r"))
    matched = units.agg(
        F.count(F.lit(1)).alias("n_players"), F.avg(dot("_l", "_r")).alias("matched_cosine"),
        Summarizer.mean(array_to_vector("_l")).alias("_ml"),
        Summarizer.mean(array_to_vector("_r")).alias("_mr"),
    ).withColumns({"_a": vector_to_array("_ml"), "_b": vector_to_array("_mr")})
    return (
        matched.withColumn("shuffled_cosine", dot("_a", "_b"))
        .withColumn("lift", F.col("matched_cosine") - F.col("shuffled_cosine"))
        .select("n_players", "matched_cosine", "shuffled_cosine", "lift")
    )


def half_season_stability(df: DataFrame, column: str, week: str = "week", split_week: int = 20) -> DataFrame:
    """Similarity of a player's mean vector between the two halves of a season."""
    rows = standardise(df, column).withColumn("_half", F.col(week) >= split_week)
    means = mean_vectors(rows.where(F.col("_half").isNotNull()), ["player_id", "_half"], "scaled", "_m")
    first = means.where(~F.col("_half")).select("player_id", F.col("_m").alias("_first"))
    second = means.where(F.col("_half")).select("player_id", F.col("_m").alias("_second"))
    return matched_similarity(first.join(second, "player_id"), "_first", "_second")


def cross_season_stability(df: DataFrame, column: str, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The same between two providers, through matched player pairs."""
    means = mean_vectors(standardise(df, column), ["provider", "player_id"], "scaled", "_m")

    def side(provider, tag):
        return means.where(F.col("provider") == provider).select(
            F.col("player_id").alias(f"player_id_{tag}"), F.col("_m").alias(f"_{tag}")
        )

    joined = pairs.join(side(left, "left"), "player_id_left").join(side(right, "right"), "player_id_right")
    return matched_similarity(joined, "_left", "_right")


def nearest(
    df: DataFrame, key: str, column: str, query, k: int = 10, where: Column | None = None
) -> DataFrame:
    """Rows most similar to one row by cosine on standardised vectors, itself left out."""
    rows = standardise(df, column).withColumn("_u", unit("scaled"))
    one = rows.where(F.col(key) == query).select(F.col("_u").alias("_q")).limit(1)
    others = rows.where(F.col(key) != query)
    if where is not None:
        others = others.where(where)
    return (
        attach_row(others, one).withColumn("cosine", dot("_u", "_q"))
        .orderBy(F.desc("cosine"), key).limit(k).drop("_u", "_q", "scaled")
    )


# --- neighbours of every row -------------------------------------------------------------

# Hash tables of the neighbour search, rows aimed at in a bucket, and rows of a bucket one task compares
# with each other at once.
TABLES, BUCKET_ROWS, CHUNK_ROWS = 16, 400, 2_048
# Rows of a block at most where all rows are compared.
PAIR_ROWS = 8_192
COSINE_DIGITS = 9


def centroids(df: DataFrame, keys, column: str, least: int = 10) -> DataFrame:
    """(keys, ``centroid``, n): mean standardised vector of each group of at least ``least`` rows."""
    means = mean_vectors(standardise(df, column), keys, "scaled", "centroid")
    return means.where(F.col("n") >= least)


def nearest_all(
    df: DataFrame, key: str, column: str, k: int = 10, other: str | None = None, scale: bool = True,
    tables: int = TABLES, seed: int = 0, exact: bool = False,
) -> DataFrame:
    """(key, place, neighbour, cosine): the k rows most similar to every row, itself left out.

    Vectors are standardised (``scale``) and of unit length. Random planes through the origin give each
    row one bucket in every table; rows that share a bucket are compared by whole cosines, so what is
    listed is exact, and a neighbour is missed only if no table has both in a bucket. A table has so
    many planes that a bucket holds about ``BUCKET_ROWS`` rows; up to that many rows all are
    compared. Larger buckets are cut into chunks, and all pairs of a bucket's chunks meet. With
    ``other`` neighbours have another value in that column. Cosines are compared on nine decimals,
    equal ones by key. Rows without a vector are left out; a zero vector has cosine 0 with all.
    ``exact`` compares all pairs of rows, however many: memory stays bounded by two blocks, time does not. Rows
    without a key are left out then.
    """
    if exact:
        return _nearest_of_all(df, key, column, k, other, scale)
    rows = standardise(df, column) if scale else df.withColumn("scaled", clean_vector(column))
    group = F.col(other) if other else F.lit(None).cast("string")
    rows = staged(rows.where(F.col(column).isNotNull()).select(
        F.col(key).alias("key"), group.cast("string").alias("g"), unit("scaled").alias("u")))
    n = rows.count()
    first = rows.select(F.size("u").alias("d")).first()
    planes = max(0, (n // BUCKET_ROWS).bit_length() - 1) if n > BUCKET_ROWS else 0
    number = tables if planes else 1
    normals = np.random.default_rng(seed).normal(size=(number, max(1, planes), first["d"] if first else 1))
    powers = 1 << np.arange(max(1, planes), dtype=np.int64)

    @F.pandas_udf("array<bigint>")
    def buckets(vectors: pd.Series) -> pd.Series:
        if not planes or not len(vectors):
            return pd.Series([[0]] * len(vectors))
        side = np.einsum("nd,tpd->ntp", np.stack(list(vectors)), normals) > 0
        return pd.Series(list(side @ powers))

    placed = staged(rows.select("*", F.posexplode(buckets("u")).alias("table", "bucket")))
    where = ["table", "bucket"]
    sizes = placed.groupBy(*where).count().select(
        *where, F.ceil(F.col("count") / CHUNK_ROWS).cast("int").alias("chunks"))
    # At most about CHUNK_ROWS rows in a list, however many share a bucket.
    packed = staged(
        placed.join(sizes, where)
        .withColumn("chunk", F.pmod(F.xxhash64("key", "table"), F.col("chunks")).cast("int"))
        .groupBy(*where, "chunks", "chunk").agg(F.collect_list(F.struct("key", "g", "u")).alias("mine"))
    )
    others = packed.select(
        *where, F.col("mine").alias("others"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    kind = df.schema[key].dataType.simpleString()

    def compare(batches):
        for batch in batches:
            for mine, theirs in zip(batch.column(0), batch.column(1)):
                mine, theirs = mine.values, theirs.values
                ids, far = mine.field("key").to_pylist(), theirs.field("key").to_pylist()
                u, v = (np.asarray(x.field("u").flatten().to_numpy(), float).reshape(len(x), -1) for x in (mine, theirs))
                order = sorted(range(len(far)), key=lambda i: far[i])
                v, far = v[order], np.array(far, dtype=object)[order]
                here = np.array(mine.field("g").to_pylist(), dtype=object)
                there = np.array(theirs.field("g").to_pylist(), dtype=object)[order]
                found = []
                for start in range(0, len(ids), 256):
                    cosine = np.round(u[start:start + 256] @ v.T, COSINE_DIGITS)
                    own = np.array(ids[start:start + 256], dtype=object)
                    barred = own[:, None] == far[None]
                    if other:
                        barred |= here[start:start + 256, None] == there[None]
                    cosine[barred.astype(bool)] = -np.inf
                    # All that reach the k-th cosine of their row; of equal ones the first by key are kept.
                    least = -np.partition(-cosine, min(k, len(far)) - 1, axis=1)[:, min(k, len(far)) - 1]
                    row, at = np.nonzero((cosine >= least[:, None]) & np.isfinite(cosine))
                    order = np.lexsort((at, -cosine[row, at], row))
                    row, at = row[order], at[order]
                    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, at = row[kept], at[kept]
                    found.append((own[row], far[at], cosine[row, at]))
                columns = [np.concatenate(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0].tolist(), mine.field("key").type), pa.array(columns[1].tolist(), mine.field("key").type),
                     pa.array(columns[2].astype(float))], names=["key", "neighbour", "cosine"])

    met = packed.join(others, [*where, "chunk"]).select("mine", "others").mapInArrow(
        compare, f"key {kind}, neighbour {kind}, cosine double")
    ranked = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    # At most k rows for each row, table and chunk reach the ranking.
    return (
        met.dropDuplicates(["key", "neighbour"]).withColumn("place", F.row_number().over(ranked))
        .where(F.col("place") <= k).select(F.col("key").alias(key), "place", "neighbour", "cosine")
    )


def _nearest_of_all(df: DataFrame, key: str, column: str, k: int, other: str | None, scale: bool) -> DataFrame:
    """``nearest_all`` over all pairs: each task keeps a block of rows with their best k so far, and reads all rows.

    Vectors travel as they are stored. Products in single precision tell which pairs may enter a list, by a bound on
    their error; these are taken again in double precision.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    rows = df.where(F.col(key).isNotNull() & F.col(column).isNotNull())
    moments = vector_moments(df, column).first() if scale else None
    n = rows.count()
    number = blocks_for(spark, n, PAIR_ROWS)
    group = (F.col(other) if other else F.lit(None)).cast("string")

    def pack(batches):
        keys, groups, vectors = [], [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            groups += batch.column(1).to_pylist()
            vectors += [np.array(v.as_py(), np.float64) for v in batch.column(2)]
        if keys:
            x = np.nan_to_num(np.stack(vectors), nan=0.0, posinf=np.inf, neginf=-np.inf)
            # Single precision holds what was stored in it.
            x = x.astype(np.float32) if (x.astype(np.float32) == x).all() else x
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys], pa.list_(batch.schema.field(0).type)), pa.array([groups], pa.list_(pa.string())),
                 pa.array([x.tobytes()], pa.binary()), pa.array([x.dtype.char])], names=["keys", "groups", "x", "kind"])

    blocks = durable(rows.select(F.col(key).alias("k"), group.alias("g"), F.col(column).alias("v")).repartition(number).mapInArrow(
        pack, f"keys array<{kind}>, groups array<string>, x binary, kind string").withColumn("block", F.spark_partition_id()))

    def units(keys, groups, x, of):
        """(keys, groups, unit vectors, the same in single precision) of a block; rows that are not finite drop out."""
        x = np.frombuffer(x.as_buffer(), of.as_py()).reshape(len(keys), -1).astype(np.float64)
        if scale:
            x = (x - np.array(moments["_mean"])) / np.array(moments["_sd"])
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        u = x / np.where(size < SMALL_NORM, 1.0, size)
        good = np.isfinite(u).all(axis=1)
        keys, groups = np.array(keys.as_py()), np.array(groups.as_py(), object)
        return keys[good], groups[good], u[good], u[good].astype(np.float32)

    def search(batches):
        held: dict = {}
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for at in range(batch.num_rows):
                block = columns["block"][at].as_py()
                if block not in held:
                    mine = units(*(columns[c][at] for c in ("keys", "groups", "x", "kind")))
                    held[block] = (mine, np.full((len(mine[0]), k), -np.inf), np.zeros((len(mine[0]), k), mine[0].dtype))
                mine, cosines, names = held[block]
                there = units(*(columns[f"{c}_there"][at] for c in ("keys", "groups", "x", "kind")))
                if names.dtype.kind == "U":
                    names = names.astype(np.promote_types(names.dtype, there[0].dtype))
                    held[block] = (mine, cosines, names)
                for start in range(0, len(mine[0]), 256):
                    for far in range(0, len(there[0]), 4096):
                        _enter(mine, there, slice(start, start + 256), slice(far, far + 4096), cosines, names, k, other)
        for (keys, *_), cosines, names in held.values():
            row, place = np.nonzero(np.isfinite(cosines))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[row].tolist(), batch.schema.field("keys").type.value_type),
                 pa.array(names[row, place].tolist(), batch.schema.field("keys").type.value_type),
                 pa.array(cosines[row, place])], names=["key", "neighbour", "cosine"])

    found = every_pair(blocks).mapInArrow(search, f"key {kind}, neighbour {kind}, cosine double")
    ranked = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return (
        found.dropDuplicates(["key", "neighbour"]).withColumn("place", F.row_number().over(ranked))
        .where(F.col("place") <= k).select(F.col("key").alias(key), "place", "neighbour", "cosine")
    )


def _enter(mine, there, some: slice, far: slice, cosines: np.ndarray, names: np.ndarray, k: int, other) -> None:
    """Let the rows ``far`` of another block into the lists of the rows ``some``: best first, equal ones by key."""
    (keys, groups, u, single), (far_keys, far_groups, v, far_single) = mine, there
    least = cosines[some, -1]
    near = single[some] @ far_single[far].T
    # The error of a product in single precision, and the rounding of the cosines.
    reach = least - (u.shape[1] + 8) * 1.2e-7 - 10.0**-COSINE_DIGITS
    row = np.flatnonzero(near.max(axis=1, initial=-np.inf) >= reach)
    if not len(row):
        return
    at, col = np.nonzero(near[row] >= reach[row, None])
    row = row[at]
    if len(row) > near.size // 16:
        cosine = (u[some] @ v[far].T)[row, col]
    else:
        cosine = np.einsum("nd,nd->n", u[some][row], v[far][col])
    row, col = row + some.start, col + far.start
    cosine = np.round(cosine, COSINE_DIGITS)
    allowed = (keys[row] != far_keys[col]) & (cosine >= cosines[row, -1])
    if other:
        allowed &= groups[row] != far_groups[col]
    row, col, cosine = row[allowed], col[allowed], cosine[allowed]
    if not len(row):
        return
    # Those listed so far and the new ones, ranked anew.
    touched = np.unique(row)
    row = np.concatenate([np.repeat(touched, k), row])
    cosine = np.concatenate([cosines[touched].ravel(), cosine])
    name = np.concatenate([names[touched].ravel(), far_keys[col]])
    order = np.lexsort((np.unique(name, return_inverse=True)[1], -cosine, row))
    row, cosine, name = row[order], cosine[order], name[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    cosines[row[kept], place[kept]] = cosine[kept]
    names[row[kept], place[kept]] = name[kept]
