"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Rows of an Arrow batch at most: texts of some kilobytes, and now and then a very long one.
ARROW_ROWS = 2000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application, and keep Arrow batches of whole texts small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lorekeep-"), "lorekeep"), "zip", os.path.dirname(home), os.path.basename(home))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
