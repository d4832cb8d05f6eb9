"""Making this package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
#: Arrow batches between Spark and Python workers are cut at so many bytes, not only at a number of rows.
BATCH_BYTES = "8m"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once a session, so that queries run from any working folder."""
    context = spark.sparkContext
    if not getattr(context, "_quillwave_shipped", False):
        target = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "quillwave.zip"
        with zipfile.ZipFile(target, "w") as out:
            for source in sorted(ROOT.rglob("*.py")):
                out.write(source, source.relative_to(ROOT.parent))
        context.addPyFile(str(target))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        context._quillwave_shipped = True
    return spark
