"""Tiny essay files into few files that hold each record once (problem 2)."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_path, table
from tessera.sources import compaction

#: Files whose records one partition of the compacted table should get, for some 128 MB, and the
#: least for which it is worth a task of its own.
BUCKET_FILES, LEAST_FILES = 400_000, 5_000
#: Batches in which a bucket's records land, each a file of its own.
WAVES = 4


def _whole(x) -> bool:
    return isinstance(x, dict) and isinstance(x.get("essay_question"), dict) and isinstance(x.get("essay_answer"), dict)


def records_in(content: str | None) -> list[dict]:
    """The complete records in one file's text.

    A file is one JSON value (a record, or a list with records in it) or lines with one each;
    where it is broken as a whole, its lines that are whole records still count.  Anything
    without question and answer objects is no record.  Null and blank texts hold none.
    """
    text = (content or "").strip("﻿ \t\r\n\x00")
    if not text:
        return []
    try:
        whole = json.loads(text)
        found = whole if isinstance(whole, list) else [whole]
    except (ValueError, RecursionError):
        found = []
        for line in text.split("\n"):
            line = line.strip("﻿ \t\r\x00")
            if line.startswith("{"):
                try:
                    found.append(json.loads(line))
                except (ValueError, RecursionError):
                    pass
    return [x for x in found if _whole(x)]


def _essay_id(x) -> int | None:
    try:
        return None if isinstance(x, bool) else int(str(x).strip())
    except ValueError:
        return None


def parsed(files: DataFrame) -> DataFrame:
    """prompt_id, essay_id, record (JSON text), file_id, received_at of each complete record.

    A record whose question or answer has no usable id is incomplete and left out.
    """
    schema = "prompt_id string, essay_id bigint, record string, file_id bigint, received_at timestamp_ntz"
    out_schema = pa.schema([("prompt_id", pa.string()), ("essay_id", pa.int64()), ("record", pa.string()), ("file_id", pa.int64()), ("received_at", pa.timestamp("us"))])

    def run(batches):
        for b in batches:
            rows = []
            for fid, at, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for r in records_in(content):
                    pid, eid = r["essay_question"].get("id"), _essay_id(r["essay_answer"].get("id"))
                    if isinstance(pid, str) and pid.strip() and eid is not None:
                        rows.append({"prompt_id": pid.strip().upper(), "essay_id": eid, "record": json.dumps(r, ensure_ascii=False), "file_id": fid, "received_at": at})
            yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    return files.select("file_id", "received_at", "content").mapInArrow(run, schema)


def compacted(spark: SparkSession, files: DataFrame, path: str, n_files: int | None = None) -> compaction.Version:
    """Write the records of ``files`` to a table at ``path``, as small files by batch, and compact it.

    The number of buckets follows the number of files, so that a bucket stays one well-sized
    file; records are hashed to buckets by their whole key, so no prompt makes a hot bucket.
    """
    n = files.count() if n_files is None else n_files
    buckets = max(1, -(-n // BUCKET_FILES), min(spark.sparkContext.defaultParallelism, n // LEAST_FILES))
    rows = parsed(files).withColumn("bucket", F.pmod(F.xxhash64("prompt_id", "essay_id"), F.lit(buckets)).cast("int"))
    # else each task would leave a file in each bucket, in all tasks times buckets
    landed = rows.repartition(buckets * WAVES, "bucket", F.pmod(F.xxhash64("file_id"), F.lit(WAVES)))
    compaction.append(landed, path, "bucket")
    return compaction.compact(spark, path, "bucket", ["prompt_id", "essay_id"], ["received_at", "file_id"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt_id, essay_id, file_id of every record in ``raw_files``, from the compacted table."""
    path = shared_path(spark, "raw-files")
    compacted(spark, table(spark, sf_dir, "raw_files"), path)
    rows = compaction.read(spark, path, "prompt_id string, essay_id bigint, record string, file_id bigint, received_at timestamp_ntz, bucket int")
    return rows.select("prompt_id", "essay_id", "file_id")


QUERIES = {"p2_found": p2_found}
SQL = {
    "p2_found": """
WITH f AS (SELECT file_id, received_at, trim(content, chr(65279) || ' ' || chr(9) || chr(13) || chr(10) || chr(0)) AS c FROM raw_files),
v AS (SELECT file_id, received_at, unnest(CASE WHEN NOT json_valid(c) THEN list_filter(string_split(c, chr(10)), lambda x: json_valid(x)) WHEN json_type(c) = 'ARRAY' THEN CAST(json_extract(c, '$[*]') AS VARCHAR[]) ELSE [c] END) AS j FROM f WHERE c <> ''),
r AS (SELECT file_id, received_at, upper(trim(json_extract_string(j, '$.essay_question.id'))) AS prompt_id, TRY_CAST(json_extract_string(j, '$.essay_answer.id') AS BIGINT) AS essay_id FROM v WHERE json_type(j) = 'OBJECT'),
k AS (SELECT *, row_number() OVER (PARTITION BY prompt_id, essay_id ORDER BY received_at DESC, file_id DESC) AS n FROM r WHERE prompt_id <> '' AND essay_id IS NOT NULL)
SELECT prompt_id, essay_id, file_id FROM k WHERE n = 1""",
}
