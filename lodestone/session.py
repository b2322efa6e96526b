"""Getting the package onto the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application.

    Workers on other machines, or started in another folder, can't import it
    otherwise.
    """
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodestone-ship-")  # Spark serves the file until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, f"{here.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, file.relative_to(here.parent))
    context.addPyFile(str(archive))
    context._lodestone_shipped = True
