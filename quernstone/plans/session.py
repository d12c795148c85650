"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows of one Arrow batch, where the session has Spark's default of 10,000: rows may hold whole texts, and a batch is held
#: by the executor's JVM and by its Python worker at once.
ARROW_ROWS, ARROW_SETTING = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Hands this package's modules to the executors, once an application, so that functions from it can run there; makes
    Arrow batches smaller than by default."""
    if spark.conf.get(ARROW_SETTING, "10000") == "10000":
        spark.conf.set(ARROW_SETTING, ARROW_ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="quernstone-")) / "quernstone.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def session(cores: str | int = "*", partitions: int = 8, name: str = "quernstone") -> SparkSession:
    """A local session with the settings that the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
