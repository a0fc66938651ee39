"""Audit of five document filters under every order in which they could be applied.

A document is reduced to its failure mask, one bit for each filter. Orders are ranked as lexicographic
permutations, so the orders that start with one prefix are neighbours: a prefix of k filters covers
(5 - k)! consecutive ranks. The step at which a mask is removed therefore fills a few rank intervals.
Counts are added at the ends of these intervals, and a running sum over the 120 ranks gives every
total. The work after the masks depends on parts and masks alone, never on documents times orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from pitchloom.runtime import staged

FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in permutations(FILTERS)]
SPACE = r"[\x20\x09-\x0D]+"

MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SYMBOLS = r"[#$%&*|]"


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text only: A to D. A null text is empty.

    A: fewer than 200 words; B: under half of the words distinct; C: over 3 capital letters (A-Z)
    in 100 code points; D: any of ``#$%&*|``.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda word: word != "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {
        "A": n_words < MIN_WORDS,
        "B": 100 * distinct.cast("long") < MIN_DISTINCT_PERCENT * n_words.cast("long"),
        "C": 100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }
    bits = [F.when(failed, bit(letter)).otherwise(0) for letter, failed in fails.items()]
    return bits[0] + bits[1] + bits[2] + bits[3]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by failure mask.

    Filter E fails for rows whose text equals that of any smaller doc_id in the table. The smallest id
    of a text is found with map-side minima and met again on (doc_id, digest), so a text that a third
    of all rows share is spread by its ids. Rows without an id are never later copies. Repeated
    rows count each; of repeated labels the larger value holds. Other columns are not read.
    """
    read = staged(docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(F.col("text")).alias("bits"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"),
    ))
    firsts = (
        read.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        .withColumn("first", F.lit(True))
    )
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("quality")).alias("quality"), F.max(F.col("toxic")).alias("toxic"))
    # Equal rows are one row with a count before they meet anything.
    rows = read.groupBy("doc_id", "digest", "part", "bits").agg(F.count(F.lit(1)).alias("n"))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (
        rows.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
        .groupBy("part", (F.col("bits") + F.when(later, bit("E")).otherwise(0)).alias("mask"))
        .agg(F.sum("n").alias("n"),
             F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("good"),
             F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    )


def intervals() -> list[tuple]:
    """(mask, step, low, high, kept, removed, redundant, only): what happens to a mask at a step.

    Ranks low to high - 1 are the orders that share a prefix of ``step`` filters.
    """
    found = []
    letters = len(FILTERS)

    def walk(prefix: str, low: int) -> None:
        step = len(prefix)
        covered = factorial(letters - step)
        if step:
            last, earlier = bit(prefix[-1]), sum(bit(c) for c in prefix[:-1])
            for mask in range(1 << letters):
                before, now = bool(mask & earlier), bool(mask & last)
                row = (not before and not now, now and not before, now and before, mask == last)
                if any(row):
                    found.append((mask, step, low, low + covered, *map(int, row)))
        for at, letter in enumerate(c for c in FILTERS if c not in prefix):
            walk(prefix + letter, low + at * factorial(letters - step - 1))

    walk("", 0)
    return found


TOTALS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step, zeros included; see ``masks`` for the filters.

    An empty table has no parts and gives no rows. Null languages are the part ''.
    """
    spark = docs.sparkSession
    counts = staged(masks(docs, labels))
    # A fixed table of a few thousand rows, from the number of filters alone.
    spans = spark.createDataFrame(
        intervals(), "mask int, step int, low int, high int, k int, r int, d int, u int")
    ends = spans.select("mask", "step", F.explode(F.array(
        F.struct(F.col("low").alias("rank"), F.lit(1).alias("sign")),
        F.struct(F.col("high").alias("rank"), F.lit(-1).alias("sign")),
    )).alias("e"), "k", "r", "d", "u").select("mask", "step", "e.rank", "e.sign", "k", "r", "d", "u")
    amount = {
        "kept": "k * n", "removed": "r * n", "redundant": "d * n", "unique_fails": "u * n",
        "good_lost": "r * good", "toxic_lost": "r * toxic",
    }
    # Map-side sums: at most parts x steps x 121 rows leave a task.
    added = counts.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(
        *(F.sum(F.expr(f"sign * {value}")).alias(name) for name, value in amount.items()))
    zeros = (
        counts.select("part").distinct()
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))))
        .select("part", "step", "rank", *(F.lit(0).cast("long").alias(name) for name in TOTALS))
    )
    # One row for each rank, then the running sum over the 120 ranks of a part and step.
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    totals = (
        added.unionByName(zeros).groupBy("part", "step", "rank")
        .agg(*(F.sum(name).alias(name) for name in TOTALS))
        .select("part", "step", "rank", *(F.sum(name).over(along).alias(name) for name in TOTALS))
        .where(F.col("rank") < len(ORDERS))
        .withColumn("filter_order", F.element_at(
            F.array(*map(F.lit, ORDERS)), F.col("rank") + 1))
        .withColumn("_filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    )
    every = Window.partitionBy("part", "_filter")
    return totals.select(
        "part", "filter_order", "step", *TOTALS, F.sum("removed").over(every).alias("shapley"))


# Every order is followed step by step, mask by mask.
AUDIT_SQL = r"""
WITH raw AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM raw
), firsts AS (SELECT text, min(doc_id) AS low FROM raw GROUP BY text
), marks AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id
), fails AS (
  SELECT s.part,
    len(s.words) < 200 AS a,
    100 * len(list_distinct(s.words)) < 50 * len(s.words) AS b,
    100 * len(regexp_replace(s.text, '[^A-Z]', '', 'g')) > 3 * len(s.text) AS c,
    regexp_matches(s.text, '[#$%&*|]') AS d,
    coalesce(s.doc_id > f.low, false) AS e,
    coalesce(m.quality = 1, false) AS good, coalesce(m.toxic = 1, false) AS toxic
  FROM split s JOIN firsts f ON s.text = f.text LEFT JOIN marks m ON s.doc_id = m.doc_id
), counts AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END)
      || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END)
      || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM fails GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT v.x || w.x || y.x || z.x || q.x AS filter_order
  FROM letters v, letters w, letters y, letters z, letters q
  WHERE w.x <> v.x AND y.x NOT IN (v.x, w.x) AND z.x NOT IN (v.x, w.x, y.x)
    AND q.x NOT IN (v.x, w.x, y.x, z.x)
), steps AS (
  SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), met AS (
  SELECT c.*, s.*, contains(c.failed, s.own) AS now,
    c.failed <> '' AND translate(c.failed, s.earlier, '') <> c.failed AS before
  FROM counts c, steps s
), totals AS (
  SELECT part, filter_order, step::INTEGER AS step, any_value(own) AS own,
    sum(n) FILTER (NOT now AND NOT before) AS kept, sum(n) FILTER (now AND NOT before) AS removed,
    sum(n) FILTER (now AND before) AS redundant, sum(n) FILTER (failed = own) AS unique_fails,
    sum(good) FILTER (now AND NOT before) AS good_lost,
    sum(toxic) FILTER (now AND NOT before) AS toxic_lost
  FROM met GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM totals
"""
