"""Table access and lineage cutting shared by all operators."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    The archive is built on the driver and served to the executors by Spark.
    """
    sc = spark.sparkContext
    if getattr(sc, "_codeloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{root.name}", "zip", root.parent, root.name)
    sc.addPyFile(archive)
    sc._codeloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table under ``sf_dir`` (one file or a folder of parts)."""
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, and only in
    local mode (tests), a temporary folder is set; on a cluster a missing setting is an error,
    because a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if (current := sc.getCheckpointDir()) is not None:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
