"""Sessions, and the package's own modules on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2 MB from here on in this session, unless they are smaller already: whole texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not 0 < int("".join(c for c in now if c.isdigit() or c == "-")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="peakloom-"), "peakloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables: folder/name.parquet, a file or a folder of files."""
    ship(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
