"""Compare registered queries with their SQL in DuckDB: python tools/check.py [sf_dir] [name or module ...]"""

import importlib
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from preflens.frames import session  # noqa: E402
from preflens.plans import registry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def kind(t):
    if pa.types.is_integer(t):
        return "int"
    if pa.types.is_floating(t):
        return "float"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "str"
    return str(t)


def rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=repr)


def compare(spark_table, sql_table):
    if sorted(spark_table.column_names) != sorted(sql_table.column_names):
        return f"columns {sorted(spark_table.column_names)} / {sorted(sql_table.column_names)}"
    for n in spark_table.column_names:
        a, b = kind(spark_table.schema.field(n).type), kind(sql_table.schema.field(n).type)
        if a != b:
            return f"type of {n}: {a} / {b}"
    if spark_table.num_rows != sql_table.num_rows:
        return f"rows {spark_table.num_rows} / {sql_table.num_rows}"
    a, b = rows(spark_table), rows(sql_table)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, e.g. {str(wrong[0])[:400]}" if wrong else None


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = session("check", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g", "spark.driver.maxResultSize": "4g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, oracle = registry.queries(), registry.oracle_sql()
    wanted = []
    for a in args or list(queries):
        wanted += [a] if a in queries else list(importlib.import_module(f"preflens.plans.{a}").QUERIES)
    bad = 0
    for name in wanted:
        t0 = time.time()
        try:
            got = queries[name](spark, sf).toArrow()
            t1 = time.time()
            if name in oracle:
                expected = con.execute(oracle[name]).to_arrow_table()
                problem = compare(got, expected)
            else:
                problem = None
            word = "ok" if name in oracle else "rows only"
            print(f"{name}: {problem or word} rows={got.num_rows} spark={t1 - t0:.1f}s sql={time.time() - t1:.1f}s", flush=True)
            bad += bool(problem)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:700]}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")


main()
