"""Consolidation of partitioned tables that consist of far too many small files.

A table is a folder of ``bucket=N`` partitions with Parquet files and a ``_versions`` folder
(hidden from readers) with one JSON manifest per committed version, which names every file of
every partition.  Writers stage their files in a hidden folder, move them beside the others and
commit a manifest that names them; readers follow the manifest (:func:`read`).  :func:`compact`
rewrites only the partitions with too many small files, or with repeated keys, and deletes the files
it has read, and no other, after its commit.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConflictError(RuntimeError):
    """Another writer changed a partition between reading it and rewriting it."""


@dataclass(frozen=True)
class Version:
    """A committed state: number, by partition the (file name, bytes) of its files, and the
    partitions whose files a compaction wrote, so that each key stands in them once."""

    number: int
    files: dict[str, tuple[tuple[str, int], ...]]
    clean: tuple[str, ...] = ()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listing(spark: SparkSession, path: str) -> dict[str, tuple[tuple[str, int], ...]]:
    """The data files by partition, from one recursive listing (metadata only, no data)."""
    fs, p = _fs(spark, path)
    out: dict[str, list[tuple[str, int]]] = {}
    if not fs.exists(p):
        return {}
    root = fs.makeQualified(p)
    it = fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        name, part = s.getPath().getName(), s.getPath().getParent().getName()
        if "=" in part and not name.startswith(("_", ".")) and s.getPath().getParent().getParent().equals(root):
            out.setdefault(part, []).append((name, s.getLen()))
    return {k: tuple(sorted(v)) for k, v in sorted(out.items())}


def current(spark: SparkSession, path: str) -> Version | None:
    """The newest committed version, or None of a table that has none."""
    fs, p = _fs(spark, f"{path}/_versions")
    if not fs.exists(p):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
    if not names:
        return None
    text = spark.read.text(f"{path}/_versions/{names[-1]}", wholetext=True).first()[0]
    v = json.loads(text)
    return Version(v["number"], {k: tuple((n, b) for n, b in fs_) for k, fs_ in v["files"].items()}, tuple(v["clean"]))


def commit(spark: SparkSession, path: str, after: Version | None, cleaned: list[str] | None = None, files: dict[str, tuple[tuple[str, int], ...]] | None = None) -> Version:
    """Record ``files``, by default what the table holds, as the version after ``after``; ``cleaned`` were rewritten.

    The manifest is created exclusively: where another writer took the number first, this
    raises :class:`ConflictError`.
    """
    files = listing(spark, path) if files is None else files
    clean = {*(cleaned or ()), *(k for k in (after.clean if after else ()) if files.get(k) == after.files.get(k))}
    v = Version((after.number if after else 0) + 1, files, tuple(sorted(clean)))
    fs, p = _fs(spark, f"{path}/_versions/{v.number:08d}.json")
    try:
        out = fs.create(p, False)
    except Exception as e:
        raise ConflictError(f"version {v.number} exists") from e
    out.write(bytearray(json.dumps({"number": v.number, "files": v.files, "clean": v.clean}).encode()))
    out.close()
    return v


def read(spark: SparkSession, path: str, schema: str | None = None, version: Version | None = None) -> DataFrame:
    """The rows of the newest version, or of ``version``, from the files it names and no other.

    A version without files needs a ``schema``.
    """
    v = version or current(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    names = [f"{path}/{k}/{n}" for k, fs_ in (v.files if v else {}).items() for n, _ in fs_]
    if not names and schema:
        return spark.createDataFrame([], schema)
    return reader.option("basePath", path).parquet(*names)


def _delete(spark: SparkSession, path: str, files: dict[str, tuple[tuple[str, int], ...]]) -> None:
    for k, fs_ in files.items():
        for n, _ in fs_:
            fs, p = _fs(spark, f"{path}/{k}/{n}")
            fs.delete(p, False)


def _staged(spark: SparkSession, writer, path: str, only: list[str] | None = None) -> dict[str, tuple[tuple[str, int], ...]]:
    """Write to a hidden folder and move the files into their partitions, which must be among ``only``."""
    stage = f"{path}/_staging-{uuid.uuid4().hex}"
    fs, p = _fs(spark, stage)
    try:
        writer.parquet(stage)
        files = listing(spark, stage)
        if only is not None and not files.keys() <= {*only}:
            raise ValueError(f"rows of {sorted({*files} - {*only})} in other partitions")
        for k, fs_ in files.items():
            fs.mkdirs(_fs(spark, f"{path}/{k}")[1])
            for n, _ in fs_:
                if not fs.rename(_fs(spark, f"{stage}/{k}/{n}")[1], _fs(spark, f"{path}/{k}/{n}")[1]):
                    raise OSError(f"{k}/{n} can't be moved")
        return files
    finally:
        fs.delete(p, True)


def _joined(*parts: dict[str, tuple[tuple[str, int], ...]]) -> dict[str, tuple[tuple[str, int], ...]]:
    keys = sorted({k for x in parts for k in x})
    return {k: tuple(sorted(f for x in parts for f in x.get(k, ()))) for k in keys}


def append(df: DataFrame, path: str, partition: str) -> Version:
    """Append rows as they lie in their tasks, however small the files get, and commit.

    Where another writer took the version's number, the files are added to that writer's version.
    """
    spark = df.sparkSession
    files = _staged(spark, df.write.partitionBy(partition), path)
    while True:
        before = current(spark, path)
        try:
            return commit(spark, path, before, files=_joined(before.files if before else {}, files))
        except ConflictError:
            if (now := current(spark, path)) is None or before is not None and now.number <= before.number:
                raise


def crowded(v: Version, small_bytes: int, max_small: int) -> list[str]:
    """Partitions with more than ``max_small`` files under ``small_bytes``."""
    return [k for k, files in v.files.items() if sum(b < small_bytes for _, b in files) > max_small]


def repeating(spark: SparkSession, path: str, v: Version, parts: list[str], partition: str, key: list[str]) -> list[str]:
    """Those of the partitions in which a key stands more than once, by a scan of their keys alone."""
    if not parts:
        return []
    rows = read(spark, path, version=Version(v.number, {k: v.files[k] for k in parts}))
    n = rows.groupBy(partition, *key).agg(F.count("*").alias("n")).where("n > 1").select(partition).distinct()
    return [f"{partition}={r[0]}" for r in n.collect()]  # at most one row by partition


def compact(
    spark: SparkSession,
    path: str,
    partition: str,
    key: list[str],
    latest: list[str],
    small_bytes: int = 32 << 20,
    max_small: int = 1,
    file_rows: int = 0,
) -> Version:
    """Rewrite the crowded partitions of the table at ``path`` and commit the next version.

    Crowded are partitions by the count of their small files alone; of the others, those that no
    compaction has gone through are rewritten where a key is repeated in them.  A rewritten partition holds each ``key`` (compared null-safe) once, namely the row with the
    largest ``latest`` columns; equal rows count as one.  Its rows go to one task per partition
    (AQE splits none, as partitions are sized by their number when the table is written), or to
    files of at most ``file_rows`` rows.  Partitions that aren't crowded keep their files byte for
    byte.  The rewrite is refused with :class:`ConflictError` where a file of a partition to rewrite
    isn't in the version that was read, or was taken away.  Files that other writers commit
    meanwhile stay beside the rewritten ones; if they replaced a file that was read, the rewrite is
    given up with :class:`ConflictError`.  In both cases nothing is deleted but what this call wrote.
    A table with nothing to rewrite, or an empty one, only returns its version.
    """
    seen = current(spark, path)
    if seen is None:
        raise ValueError(f"no version at {path}")
    todo = crowded(seen, small_bytes, max_small)
    checked = [k for k in seen.files if k not in todo and k not in seen.clean]
    todo += repeating(spark, path, seen, checked, partition, key)
    if not todo:
        return seen
    now = listing(spark, path)
    for k in todo:
        if now.get(k) != seen.files[k]:
            raise ConflictError(f"{k} changed since version {seen.number}")
    old = {k: seen.files[k] for k in todo}
    rows = read(spark, path, version=Version(seen.number, old))
    others = [c for c in rows.columns if c not in {partition, *key}]
    order = F.struct(*latest)
    kept = rows.groupBy(partition, *key).agg(F.max_by(F.struct(*others), order).alias("_row"))
    kept = kept.select(*key, "_row.*", partition)
    writer = kept.repartition(partition).sortWithinPartitions(partition, *key).write.partitionBy(partition)
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    new = _staged(spark, writer, path, todo)
    after = seen
    while True:
        if any(not {*old[k]} <= {*after.files.get(k, ())} for k in todo):
            _delete(spark, path, new)
            raise ConflictError(f"files of version {seen.number} were replaced by version {after.number}")
        rest = {k: tuple(f for f in fs_ if f not in old.get(k, ())) for k, fs_ in after.files.items()}
        try:
            cleaned = [k for k in todo if not rest.get(k)] + [k for k in checked if k not in old and after.files.get(k) == seen.files[k]]
            v = commit(spark, path, after, cleaned, {k: fs_ for k, fs_ in _joined(rest, new).items() if fs_})
        except ConflictError:
            later = current(spark, path)
            if later.number <= after.number:
                _delete(spark, path, new)
                raise
            after = later
            continue
        _delete(spark, path, old)
        return v
