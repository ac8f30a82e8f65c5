"""Session factory, scoped settings, and shipping of this package to workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(name: str = "haulgrid", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the defaults above; settings (with _ for .) come on top."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings that hold inside the block; what was there before comes back, also after an error."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where their path doesn't hold it already."""
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(ship, "to", None) == spark.sparkContext.applicationId:
        return
    folder = tempfile.mkdtemp(prefix="haulgrid-ship-")  # executors fetch from it when their first task comes
    shutil.copytree(root / "haulgrid", f"{folder}/src/haulgrid", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/haulgrid", "zip", f"{folder}/src"))
    ship.to = spark.sparkContext.applicationId
