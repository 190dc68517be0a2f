"""Makes this package importable for Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, GroupedData, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's code to the workers, once a session."""
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    here = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='fieldweave-code-')}/fieldweave.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(p.relative_to(here.parent)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(key)


def grouped(df: DataFrame, *keys: str) -> GroupedData:
    """Groups for a Python map, dealt over as many tasks as the session shuffles to. Such groups are few bytes and much
    work; adaptive execution merges partitions by bytes and would put them all into one task."""
    spark = df.sparkSession
    ship(spark)
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)
