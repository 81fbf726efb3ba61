"""Session helpers: a local session for tests and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "gristmill", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRISTMILL_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once a session, so that it need not be installed there."""
    sc = spark.sparkContext
    if not getattr(sc, "_gristmill_shipped", False):
        here = Path(__file__).resolve().parent
        if here.is_dir():  # not itself running from a shipped copy
            archive = Path(tempfile.mkdtemp(prefix="gristmill-ship-")) / "gristmill_package.zip"
            with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
                for f in sorted(here.rglob("*")):
                    if f.is_file() and "__pycache__" not in f.parts:
                        z.write(f, f"{here.name}/{f.relative_to(here)}")
            sc.addPyFile(str(archive))
        sc._gristmill_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: that of ``spark.checkpoint.dir``.

    Where it is unset, one machine alone may use a temporary folder; on a cluster its executors
    would not see each other's, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="gristmill-")


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back with its lineage cut.

    The copy survives the loss of executors, unlike a local checkpoint. It is removed once
    nothing in the session refers to it any more.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)
