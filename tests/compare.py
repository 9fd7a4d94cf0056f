"""Compare every query with its DuckDB SQL: `python -m tests.compare [data folder] [names...]`."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(data_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from '{data_dir}/{name}.parquet'")
    return db


# DuckDB type of each Spark type the queries return.
TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark, data_dir, query, sql, db):
    """None when both results are equal, else what differs."""
    frame = query(spark, data_dir)
    ours = sorted_rows(frame.columns, frame.collect())
    result = db.sql(sql)
    names = result.columns
    theirs = sorted_rows(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    types = {name: str(kind) for name, kind in zip(names, result.types)}
    odd = [(n, kind, types[n]) for n, kind in frame.dtypes if TYPES.get(kind) != types[n]]
    if odd:
        return f"types {odd}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} rows, first {wrong[0]}" if wrong else None


def main(data_dir="/root/testdata/sf0.01", *names):
    from __spark_entry__ import oracle_sql, queries
    from verdictflow.session import build_session

    spark = build_session(
        **{
            "spark.master": "local[8]",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duck(data_dir)
    oracles = oracle_sql()
    for name, query in queries().items():
        if name in oracles and (not names or name in names):
            start = time.time()
            wrong = difference(spark, data_dir, query, oracles[name], db)
            print(f"{name:24s} {time.time() - start:6.2f}s {wrong or 'equal'}", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
