"""Session defaults shared by tests, bench and the driver entry."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)} | more
    return builder.config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for each context, so that functions run there wherever it is installed."""
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "millrace.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path("millrace") / path.relative_to(root))
    context.addPyFile(str(archive))
    context._millrace_shipped = True
