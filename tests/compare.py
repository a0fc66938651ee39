"""Run registered queries beside their SQL on DuckDB and compare whole results.

usage: python tests/compare.py [--sf sf0.01] [name-pattern ...]
"""

from __future__ import annotations

import math
import os
import re
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "~" if math.isnan(value) else f"{round(value, 9) + 0.0:.9f}"
    if isinstance(value, int):
        return f"{float(value):.9f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if hasattr(value, "toArray"):
        return "[" + ",".join(_cell(float(v)) for v in value.toArray()) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def run(spark, con, name, query, sql, folder):
    started = time.time()
    frame = query(spark, folder)
    found = [tuple(row) for row in frame.collect()]
    took = time.time() - started
    head, mine = rows_of(frame.columns, found)
    if sql is None:
        return f"{name:38s} rows-only {len(mine):7d} rows {took:6.2f}s", len(mine) > 0
    result = con.execute(sql)
    other_head, theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if head != other_head:
        return f"{name:38s} COLUMNS {set(head) ^ set(other_head)}", False
    if mine == theirs:
        empty = "" if mine else " EMPTY"
        return f"{name:38s} ok {len(mine):7d} rows {took:6.2f}s{empty}", bool(mine)
    left, right = set(mine) - set(theirs), set(theirs) - set(mine)
    text = f"{name:38s} DIFF mine={len(mine)} sql={len(theirs)} only-mine={len(left)} only-sql={len(right)}"
    text += f"\n   {head}\n   mine {sorted(left)[:2]}\n   sql  {sorted(right)[:2]}"
    return text, False


def main(arguments):
    folder, wanted = "/root/testdata/sf0.01", []
    while arguments:
        item = arguments.pop(0)
        if item == "--sf":
            folder = f"/root/testdata/{arguments.pop(0)}"
        else:
            wanted.append(item)
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(folder), entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if wanted and not any(re.search(w, name) for w in wanted):
            continue
        try:
            text, good = run(spark, con, name, query, sqls.get(name), folder)
        except Exception as error:  # report and go on to the next query
            text, good = f"{name:38s} ERROR {type(error).__name__}: {str(error)[:1500]}", False
        print(text, flush=True)
        if not good:
            bad.append(name)
    print("BAD:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
