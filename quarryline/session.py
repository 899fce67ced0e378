"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once per application, so that no executor needs it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder_ = tempfile.mkdtemp(prefix="quarryline-")  # read by the driver alone, which serves it
    atexit.register(shutil.rmtree, folder_, True)
    path = os.path.join(folder_, "quarryline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("quarryline", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, "2000")  # whole texts are rows here: the default of 10,000 of them at once is a lot
    _shipped.add(app)
