"""What a session needs before Python functions of this package run on it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
ROOT = str(PACKAGE.parent)
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: where the driver did in local mode, else from an archive that Spark hands to every executor."""
    context = spark.sparkContext
    if context.master.split("[")[0] == "local":
        paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    elif context.applicationId not in _shipped:
        # The driver serves the archive from where it is, so that stays until the driver ends.
        _shipped[context.applicationId] = folder = tempfile.TemporaryDirectory(prefix="rowforge-")
        archive = os.path.join(folder.name, f"{PACKAGE.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for file in sorted(PACKAGE.rglob("*.py")):
                z.write(file, file.relative_to(PACKAGE.parent))
        context.addPyFile(archive)
    return spark
