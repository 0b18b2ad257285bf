"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def build(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session with the settings the library is tested under: UTC, ANSI, adaptive execution."""
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(_PACKAGE.parent), os.environ.get("PYTHONPATH")) if x)
    spark = (
        SparkSession.builder.master(master)
        .appName("verdica")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="verdica-src-")) / "verdica_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in _PACKAGE.rglob("*.py"):
            z.write(path, path.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
