"""Makes this package importable by executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a session, unless their Python path or folder has it."""
    app = spark.sparkContext.applicationId
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _shipped or _ROOT in on_path:
        return
    _shipped.add(app)
    out = os.path.join(tempfile.mkdtemp(prefix="faultline-"), "faultline.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(os.path.join(_ROOT, "faultline")):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, _ROOT))
    spark.sparkContext.addPyFile(out)
