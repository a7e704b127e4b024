"""Send this package to the Python workers of a session that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT = "_acopio_sent"


def ship(spark: SparkSession) -> None:
    """Once per Spark context; a no-op where the workers' PYTHONPATH has the repository."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if getattr(sc, _SENT, False) or any(p and Path(p).resolve() == root for p in on_path):
        return
    where = Path(tempfile.mkdtemp(prefix="acopio-")) / "acopio_package.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted((root / "acopio").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(where))
    setattr(sc, _SENT, True)
