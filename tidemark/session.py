"""What a session needs before Python functions of this package run on its workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_package(spark: SparkSession) -> None:
    """Let workers import this package: from where the driver did, and on a cluster from a copy that Spark hands out."""
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if not sc.master.startswith("local[") and sc.master != "local" and not getattr(sc, "_tidemark_shipped", False):
        sc.addPyFile(archive())
        sc._tidemark_shipped = True


def archive() -> str:
    """A zip file of this package; the driver serves it to executors."""
    made = tempfile.mkdtemp(prefix="tidemark-package-")
    name = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(ROOT, name), os.path.join(made, "in", name), ignore=shutil.ignore_patterns("__pycache__"))
    return shutil.make_archive(os.path.join(made, name), "zip", os.path.join(made, "in"))
