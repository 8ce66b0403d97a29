"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(cpus: str | int = "*", memory: str = "16g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the package relies on (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gridloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once a session; workers then import it from the archive Spark serves."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom_pkg.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    sc.addPyFile(archive)
    sc._gridloom_shipped = True
