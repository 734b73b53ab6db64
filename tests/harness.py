"""Run registered queries against their oracle SQL.

    python tests/harness.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from changeloom.catalog import load  # noqa: E402
from changeloom.catalog.registry import TABLES  # noqa: E402
from changeloom.session import with_defaults  # noqa: E402

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


def make_session() -> SparkSession:
    builder = (
        SparkSession.builder.master("local[8]").appName("changeloom-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", "/tmp/changeloom-warehouse")
    )
    spark = with_defaults(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def make_duckdb(directory: Path) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{directory}/{table}.parquet')")
    return connection


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 9)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, directory, build, sql):
    """Returns (problem or None, row count, seconds)."""
    started = time.time()
    df = build(spark, str(directory))
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return None, len(rows), seconds
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(rows), seconds
    oracle_types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    if oracle_types != dict(df.dtypes):
        return f"types {sorted(df.dtypes)} != {sorted(oracle_types.items())}", len(rows), seconds
    actual = rows_of(df.columns, rows)
    if actual != expected:
        extra = [r for r in actual if r not in set(expected)][:3]
        missing = [r for r in expected if r not in set(actual)][:3]
        return (f"{len(actual)} rows != {len(expected)} rows; columns {sorted(names)}\n   only spark:  {extra}\n"
                f"   only oracle: {missing}")[:1200], len(rows), seconds
    return None, len(rows), seconds


def main(argv):
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    directory = DATA / f"sf{sf}"
    queries, oracles = load()
    spark, connection = make_session(), make_duckdb(directory)
    bad = 0
    for name, build in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            problem, count, seconds = compare(spark, connection, directory, build, oracles.get(name))
        except Exception as error:  # report and go on with the next query
            problem, count, seconds = f"{type(error).__name__}: {str(error)[:400]}", -1, 0.0
        bad += problem is not None
        kind = "oracle" if name in oracles else "rows  "
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:45s} {count:8d} rows {seconds:6.2f}s", flush=True)
        if problem:
            print("   " + problem, flush=True)
    print(f"{bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
