"""Writers of tables, logs and reports."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_file(df: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A Parquet or CSV table by its suffix; other suffixes are an error before anything is written."""
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode(mode).partitionBy(*partition).parquet(path)
    elif path.rstrip("/").endswith(".csv"):
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"neither .parquet nor .csv: {path}")


def sheet(df: DataFrame, path: str, most: int = 100_000) -> int:
    """A CSV with a byte order mark for spreadsheets, on the driver; ValueError beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        w.writerows(rows)
    return len(rows)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows appended to a folder of JSON lines; nothing there is touched."""
    df.write.mode("append").json(path)


def append_once(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys aren't in the log yet, each key once; how many.

    The resume rule of the job logs: keys that are done are left alone.
    """
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    try:
        done = spark.read.schema(df.schema).json(path).select(*keys).distinct()
        new = new.join(done, keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = new.count()
    if n:
        append_jsonl(new, path)
    return n


def markdown(df: DataFrame, title: str, most: int = 500) -> str:
    """A small table as Markdown; beyond ``most`` rows the rest is counted, not shown."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"\nFirst {most} rows of more.")
    return "\n".join(lines) + "\n"


def provenance(path: str, **facts) -> None:
    """A JSON of facts beside a table."""
    Path(path).write_text(json.dumps(facts, ensure_ascii=False, indent=2, sort_keys=True, default=str), encoding="utf-8")


def registry_row(path: str, header: Sequence[str], row: Sequence) -> None:
    """One row appended to a Markdown registry; the header is written once."""
    p = Path(path)
    text = p.read_text(encoding="utf-8") if p.exists() else ""
    if not text:
        text = "| " + " | ".join(header) + " |\n|" + "---|" * len(header) + "\n"
    p.write_text(text + "| " + " | ".join(map(str, row)) + " |\n", encoding="utf-8")


def model_input(scores: DataFrame) -> DataFrame:
    """Rows for an ordinal mixed model: the half-even level of the raters' mean, and the factors."""
    return scores.select("essay_id", "trait", F.rint((F.col("r1") + F.col("r2")) / 2).cast("int").alias("score_level"), "grade", "prompt_id").where("score_level IS NOT NULL")
