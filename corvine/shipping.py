"""Making the package importable in the Python workers of a local session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from corvine.scratch import is_local

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to a local session once, wherever it was started.

    On a cluster the package is installed on the executors or passed with --py-files.
    """
    app = spark.sparkContext.applicationId
    if app in _DONE or not is_local(spark):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-corvine-")) / "corvine_sources.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _DONE.add(app)
