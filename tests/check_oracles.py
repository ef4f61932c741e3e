"""Run registered queries and their SQL side by side: ``python tests/check_oracles.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[str, int]:
    df = fn(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows only", len(got)
    rel = con.sql(sql)
    want_names, want = rows_of(rel.columns, rel.fetchall())
    if got_names != want_names:
        return f"COLUMNS {sorted(set(got_names) ^ set(want_names))}", len(got)
    if len(got) != len(want):
        return f"ROWS spark {len(got)} sql {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(n, a, b) for n, a, b in zip(got_names, g, w, strict=True) if a != b]
        return f"VALUES {len(bad)} rows, first {diff[:4]}", len(got)
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    spark_kinds = dict(df.dtypes)
    same = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER": "int"}
    off = [(c, spark_kinds[c], k) for c, k in kinds.items() if same.get(k) != spark_kinds[c]]
    return (f"TYPES {off}" if off else "ok"), len(got)


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = duck(sf_dir), entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    failed = 0
    for name in names:
        t = time.time()
        try:
            verdict, n = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as e:
            verdict, n = f"ERROR {type(e).__name__}: {str(e)[:300]}", -1
            if len(sys.argv) > 2:
                traceback.print_exc()
        failed += verdict not in ("ok", "rows only")
        print(f"{name:28s} {n:8d} {time.time() - t:6.1f}s  {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
