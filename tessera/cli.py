"""Run queries by name: ``python -m tessera.cli QUERY... --data DIR [--out DIR] [--report]``."""

from __future__ import annotations

import argparse
import sys


def all_queries() -> dict:
    from tessera.plans import registry

    out = registry.queries()
    try:
        from importlib import import_module

        out |= import_module("__spark_entry__").queries()
    except ImportError:
        pass
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description="Run queries over a folder of Parquet tables.")
    p.add_argument("query", nargs="*", help="names; none lists them")
    p.add_argument("--data", help="the folder with the tables")
    p.add_argument("--out", help="write each result to OUT/QUERY.parquet")
    p.add_argument("--report", action="store_true", help="print each result as Markdown")
    p.add_argument("--explain", action="store_true", help="print each plan")
    p.add_argument("--master", help="a Spark master; by default that of spark-submit, else local[*]")
    a = p.parse_args(argv)
    queries = all_queries()
    if not a.query:
        print("\n".join(sorted(queries)))
        return 0
    unknown = [q for q in a.query if q not in queries]
    if unknown or not a.data:
        print(f"unknown: {unknown}" if unknown else "--data is missing", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from tessera.session import local_session
    from tessera.sources.writers import markdown, table_file

    spark = SparkSession.getActiveSession() or (SparkSession.builder.master(a.master).getOrCreate() if a.master else local_session())
    for q in a.query:
        df = queries[q](spark, a.data)
        if a.explain:
            df.explain("formatted")
        if a.out:
            table_file(df, f"{a.out}/{q}.parquet")
        if a.report or not (a.out or a.explain):
            print(markdown(df, q))
    return 0


if __name__ == "__main__":
    sys.exit(main())
