"""Session settings, and where lineage is cut.

Nothing here is tied to one machine: the checkpoint folder is read from the
session (``spark.checkpoint.dir``) and only a session that names none, such as a
local test, gets one of its own.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pagewright") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAGEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage; set one only where the session has none.

    A cut frame's files go when nothing refers to the frame any more, so that queries leave nothing behind.
    """
    jsc = spark.sparkContext._jsc.sc()
    jsc.conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if jsc.getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            spark.sparkContext.setCheckpointDir(configured)
        elif spark.sparkContext.master.startswith("local"):
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that several uses read it once
    and a lost executor never makes an earlier stage run again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that their Python finds it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pagewright-")) / "pagewright.zip"  # the driver serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
