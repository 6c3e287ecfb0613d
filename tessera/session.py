"""Session defaults and the places where intermediate tables may be written."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "tessera", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    }
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=base | conf).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once by application.

    Spark serves the archive from the driver, so nothing has to be installed or shared.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # it was shipped as an archive already
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    folder = Path(tempfile.mkdtemp(prefix="tessera-package-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    (folder / "tessera.zip").write_bytes(data.getvalue())
    sc.addPyFile(str(folder / "tessera.zip"))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master, where driver and executors are one process, falls back to a
    temporary folder; on a cluster a missing setting is an error rather than a silent
    write to one machine's disk.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below :func:`shared_dir` for a table that an operator writes."""
    return f"{shared_dir(spark)}/tessera-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
