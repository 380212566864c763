"""Session settings, shared work folder and lineage cutting."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lifeledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects (AQE with skew handling, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints and prepared tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, where driver and
    executors share one machine, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lifeledger-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the work folder that no other run uses."""
    return os.path.join(work_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor never replays an iterative plan."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_folder(spark))
    return df.checkpoint(eager=True)


#: Spark 4.1 and later remove the shuffle files of a query at its end if this is set.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside give their shuffle files back when they end, not when the driver next collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def store(df: DataFrame) -> DataFrame:
    """As :func:`cut_lineage` for a stage with large shuffles: once it is stored, their files are gone."""
    with freeing_shuffles(df.sparkSession):
        # A query takes the setting of the moment in which it is made.
        return cut_lineage(df.select("*"))


def by_value(module: str) -> None:
    """Pickle this module's functions by value, so that Python workers need not import the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
