"""The library on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HOME = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's Python workers, once a context, so that they can import it wherever they run."""
    sc = spark.sparkContext
    if not any(x.startswith("kinetra-") for x in sc._python_includes):
        path = Path(tempfile.mkdtemp(), f"kinetra-{sc.applicationId}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(_HOME.rglob("*.py")):
                z.write(p, p.relative_to(_HOME.parent))
        sc.addPyFile(str(path))
    return spark
