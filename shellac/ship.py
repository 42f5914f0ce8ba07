"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, unless PYTHONPATH has it or it was added before."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_shellac_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "shellac.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((ROOT / "shellac").rglob("*.py")):
            out.write(source, source.relative_to(ROOT))
    context.addPyFile(str(archive))
    context._shellac_shipped = True
