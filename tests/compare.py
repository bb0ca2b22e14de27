"""Run registered queries next to their SQL twins: ``python tests/compare.py [name ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def duck(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def differences(spark, con, run, sql, sf_dir=SF_DIR) -> str | None:
    """None where both sides agree, else a short description."""
    df = run(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if ours != theirs:
        mine = [r for r in ours if r not in set(theirs)][:3]
        other = [r for r in theirs if r not in set(ours)][:3]
        return f"{len(ours)} rows != {len(theirs)} rows; only here {mine}; only there {other}"
    return None if ours else "no rows"


def main(names: list[str]) -> int:
    from leafwork.catalog.registry import REGISTRY

    spark, con, bad = session(), duck(), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names or REGISTRY:
        run, sql = REGISTRY[name]
        start = time.time()
        try:
            if sql:
                problem = differences(spark, con, run, sql)
            else:
                n = run(spark, SF_DIR).count()
                problem = None if n else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if sql else '(rows only)'} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
