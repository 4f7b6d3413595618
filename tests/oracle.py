"""Run catalogue queries beside their SQL in DuckDB and report differences."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if value == 0 and math.copysign(1, value) < 0:
            return "-0.0"
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    return str(value)


def _rows(table, columns):
    data = [table.column(c).to_pylist() for c in columns]
    return sorted(tuple(_plain(v) for v in row) for row in zip(*data))


def compare(df, sql: str, con) -> str | None:
    """None when equal, else a description of the first difference."""
    left = df.toArrow()
    right = con.sql(sql).to_arrow_table()
    columns = sorted(left.column_names)
    if columns != sorted(right.column_names):
        return f"columns {columns} != {sorted(right.column_names)}"
    a, b = _rows(left, columns), _rows(right, columns)
    problems = []
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        missing, extra = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        problems.append(f"columns {columns}\n spark only {len(missing)}: {missing[:3]}\n sql only {len(extra)}: {extra[:3]}")
    types = {c: (str(left.schema.field(c).type).replace("large_", ""), str(right.schema.field(c).type).replace("large_", "")) for c in columns}
    odd = {c: t for c, t in types.items() if t[0] != t[1] and "list" not in t[0]}
    if odd:
        problems.append(f"types {odd}")
    if not a:
        problems.append("no rows")
    return "\n".join(problems) or None


def session(shuffle: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry_points

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = session(), connection(sf_dir)
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(build(spark, sf_dir), oracles[name], con)
            else:
                n = len(build(spark, sf_dir).toArrow())
                problem = None if n else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok'} {name} [{kind}] {time.time() - start:.2f}s" + (f"\n{problem}" if problem else ""), flush=True)
    print("failures", bad)
