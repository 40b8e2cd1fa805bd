"""What a session needs before operators run on its workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Gives the workers of this session the package, once, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_quantaloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    if root.is_dir():  # else it came as an archive, and workers have that
        folder = os.path.realpath(tempfile.mkdtemp(prefix="quantaloom-ship-"))
        context.addPyFile(shutil.make_archive(f"{folder}/quantaloom", "zip", root, "quantaloom"))
    context._quantaloom_shipped = True
