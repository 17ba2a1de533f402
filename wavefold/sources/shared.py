"""What driver and executors share: a folder, and this package's code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the Python workers, once a session, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="wavefold-"))
    with zipfile.ZipFile(f"{folder}/{_PACKAGE.name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    context.addPyFile(f"{folder}/{_PACKAGE.name}.zip")
    _SHIPPED.add(context.applicationId)


def root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on a local master without that setting, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + _OWN.setdefault("own", tempfile.mkdtemp(prefix="wavefold-"))
    return named.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{root(spark)}/wavefold/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """The rows, written there and read again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
