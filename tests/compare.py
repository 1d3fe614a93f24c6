"""Run registered queries in Spark and DuckDB over the same folder and compare all rows."""

from __future__ import annotations

import collections
import datetime
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple((type(r[i]).__name__, canonical(r[i])) for i in order) for r in rows)


def compare(spark, con, query, sql, folder):
    """(equal, rows, text of a difference)"""
    df = query(spark, folder)
    ours = bag(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = bag(names, cursor.fetchall())
    rows = sum(ours.values())
    if sorted(df.columns) != sorted(names):
        return False, rows, f"columns {sorted(df.columns)} != {sorted(names)}"
    if ours != theirs:
        return False, rows, f"{rows} vs {sum(theirs.values())} rows; only Spark: {list(ours - theirs)[:2]}; only DuckDB: {list(theirs - ours)[:2]}"
    return True, rows, ""


if __name__ == "__main__":
    from fleetspark import catalog
    from fleetspark.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("COMPARE_TZ", "UTC"))
    con = connect(folder)
    bad = 0
    for name, query in catalog.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            if name in catalog.ORACLES:
                ok, rows, text = compare(spark, con, query, catalog.ORACLES[name], folder)
            else:
                ok, rows, text = True, len(query(spark, folder).collect()), "(no SQL)"
        except Exception as error:  # noqa: BLE001
            ok, rows, text = False, -1, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        if ok and not rows:
            text += " EMPTY"
        print(f"{'ok  ' if ok else 'FAIL'} {name:32} rows={rows:7} {time.time() - began:6.2f}s {text}", flush=True)
    print(f"{bad} failed")
