"""Cutting the lineage of loops."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: computed once, and read again by what follows, also after an executor is lost.

    It lies in the folder that ``spark.checkpoint.dir`` names, which all executors share; only a local master without
    that setting gets one of its own. Spark deletes it once nothing refers to it, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        if not named:
            named = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()
